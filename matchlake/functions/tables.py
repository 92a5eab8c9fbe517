"""Word lists, maps, thresholds and weights that results depend on."""

from __future__ import annotations

# Ranker features in order and their weights.
RANKER = {
    "visual_gap": 26.89784,
    "visual_far": 6.22669,
    "text_share": 1.25038,
    "text_log": 0.26364,
    "coverage": 9.00645,
    "sweetness": 0.6606,
    "colour": 0.79866,
    "year": -0.15175,
    "text_leader": 0.07948,
    "contradiction": -0.17179,
    "text_margin": 3.60001,
    "photo_text_share": 0.92562,
    "photo_text_log": 0.29754,
}
VISUAL_K, TEXT_N, FAR_KNEE = 20, 10, 0.08

# Decision thresholds.
FUSION = {"match": 0.4, "lead": 0.6, "visual_lead": 0.06, "share": 0.5, "share_gap": 0.1, "text": 0.4, "text_lead": 0.25, "text_coverage": 0.2, "uncertain": 0.35, "uncertain_visual": 0.65}
VISUAL = {"threshold": 0.75, "margin": 0.04, "clear": 0.85, "floor": 0.70, "floor_margin": 0.035, "uncertain": 0.65}
TEXT_MATCH, TEXT_UNCERTAIN, SEARCH_FLOOR = 0.55, 0.30, 0.25
SIBLING_GAP, SIBLING_OWN, SIBLING_LEAD_SHARE = 0.05, 2.0, 2 / 3
DISTINCTIVE_GAP = 0.06
GRAPE_LINE_SCORE, GRAPE_LINE_LEAD = 0.40, 0.04
OCR_WEIGHT, LEADER_LOCK, OCR_SIBLING_DELTA, OCR_SIBLING_GAP, FUZZY_RATIO = 0.12, 0.02, 0.06, 0.05, 0.88
PSEUDO_F1_SCALE = 0.15
RETENTION_DAYS = 30
FIELD_WEIGHTS = {"name": 2.0, "winery": 1.5, "grapes": 0.8, "slug": 0.8, "style": 0.5}
EXACT, FUZZY, GLUED = 1.0, 0.6, 0.8

# Cyrillic to Latin.
TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Glyphs that look like Cyrillic capitals.
TO_CYRILLIC = {"a": "а", "b": "в", "c": "с", "e": "е", "h": "н", "k": "к", "m": "м", "o": "о", "p": "р", "t": "т", "x": "х", "y": "у", "3": "з", "6": "б"}
LOOKALIKES = "abcehkmoptxy"
# Greek letters read for Cyrillic ones.
GREEK = {
    "Α": "А", "Β": "В", "Γ": "Г", "Δ": "Д", "Ε": "Е", "Ζ": "З", "Η": "Н", "Κ": "К", "Λ": "Л", "Μ": "М", "Ο": "О", "Π": "П", "Ρ": "Р", "Τ": "Т", "Υ": "У", "Φ": "Ф", "Χ": "Х",
    "α": "а", "γ": "г", "δ": "д", "ε": "е", "κ": "к", "λ": "л", "μ": "м", "ο": "о", "π": "п", "ρ": "р", "τ": "т", "υ": "у", "φ": "ф", "χ": "х",
}
# Digits read as letters.
DIGITS = {"о": "0", "o": "0", "з": "3", "б": "6"}
# Grape and style terms in both scripts.
TERMS = {
    "каберне": ["cabernet"], "совиньон": ["sauvignon"], "фран": ["franc"], "мерло": ["merlot"], "пино": ["pinot"], "нуар": ["noir"], "блан": ["blanc", "blancs"], "гри": ["gris"],
    "гриджио": ["grigio"], "шардоне": ["chardonnay"], "рислинг": ["riesling"], "сира": ["syrah", "shiraz", "шираз"], "мускат": ["muscat", "moscato"], "алиготе": ["aligote"],
    "ркацители": ["rkatsiteli", "rkaciteli"], "вионье": ["viognier"], "шенен": ["chenin"], "траминер": ["traminer", "gewurztraminer"], "мальбек": ["malbec"],
    "санджовезе": ["sangiovese"], "темпранильо": ["tempranillo"], "розе": ["rose", "rosé"], "руж": ["rouge"], "брют": ["brut"], "резерв": ["reserve", "reserva", "riserva"],
    "саперави": ["saperavi"], "кокур": ["kokur"], "красностоп": ["krasnostop"], "цимлянский": ["tsimlyansky"], "менье": ["meunier"], "мускатель": ["muscatel"],
    "гевюрцтраминер": ["gewurztraminer"], "гренаш": ["grenache"], "марселан": ["marselan"], "одесский": ["odessky"], "бастардо": ["bastardo"], "херес": ["sherry", "jerez"],
    "пти": ["petit"], "вердо": ["verdot"], "мурведр": ["mourvedre"], "кюве": ["cuvee"], "оранж": ["orange"], "игристое": ["sparkling", "spumante"],
}
# Words that tell nothing.
STOP = (
    "вино вина wine vino винодельня winery россия россии russia год урожая сорт сорта винограда the and of de из для выдержка vin вин защищенного географического "
    "указания наименования места происхождения произведено объем крепость продукт"
).split()
# Style phrases by group, in order of priority.
STYLES = {
    "sweetness": [
        ("extra_brut", ["экстра брют", "extra brut", "ekstra bryut"]),
        ("brut", ["брют", "brut", "bryut"]),
        ("semi_dry", ["полусухое", "polusuhoe", "semi dry", "demi sec"]),
        ("semi_sweet", ["полусладкое", "polusladkoe", "semi sweet"]),
        ("dry", ["сухое", "suhoe", "dry", "secco", "trocken"]),
        ("sweet", ["сладкое", "sladkoe", "sweet", "десертное", "ликерное", "dolce"]),
    ],
    "colour": [
        ("rose", ["розовое", "rozovoe", "rose", "rosé", "розе", "rosato", "rosado"]),
        ("orange", ["оранжевое", "oranzhevoe", "orange"]),
        ("red", ["красное", "krasnoe", "red", "rosso", "rouge", "tinto"]),
        ("white", ["белое", "beloe", "white", "bianco", "blanc", "blanco"]),
    ],
}
# Style words, which do not add to a name's score.
STYLE_WORDS = (
    "сухое полусухое полусладкое сладкое брют экстра красное белое розовое оранжевое suhoe polusuhoe polusladkoe sladkoe bryut ekstra krasnoe beloe rozovoe oranzhevoe "
    "dry brut extra red white"
).split()
# Words of a label's text that are no evidence.
LABEL_STOP = "вино вина сухое полусухое полусладкое сладкое красное белое розовое оранжевое the and wine estate chateau reserve резерв усадьба".split()
# Recognition modes.
MODES = ["combined", "image_full", "image_auto", "image_auto_enhanced", "ocr_full", "ocr_auto", "ocr_auto_enhanced"]
SWEETNESS_MARKERS = ["сухое", "полусухое", "полусладкое", "сладкое", "брют"]

# Occasions with their label, dish stems, colours and reason.
OCCASIONS = {
    "meat": ("Мясо", ["мясо", "стейк", "гриль", "баранина", "говядина", "шашлык"], ["red"], "Подходит к мясу"),
    "fish": ("Рыба", ["рыба", "морепродукты", "устриц", "креветк"], ["white", "sparkling", "rose"], "К рыбе"),
    "cheese": ("Сыр", ["сыр", "сыры"], ["white", "red", "sparkling"], "К сыру"),
    "dessert": ("Десерт", ["десерт", "выпечк", "фрукты", "шоколад"], ["white", "red", "rose"], "К десерту"),
    "aperitif": ("Без еды", ["закуск", "аперитив"], ["sparkling", "white", "rose"], "Без еды"),
}
VALID_COLOURS = ["any", "white", "red", "rose", "sparkling"]
VALID_SWEETNESS = ["any", "dry", "semi_dry", "semi_sweet", "sweet"]
LIGHT_RED = ["пино", "гаме", "санджовез", "барбера", "гренаш", "гарнач", "цвейгельт"]
HEAVY_RED = ["каберне", "сира", "шираз", "мальбек", "саперави"]
# Aroma patterns and notes, in order.
AROMAS = [
    ("клубник|землян", "Клубника"),
    ("малин", "Малина"),
    ("шоколад|какао", "Шоколад"),
    ("лимон|лайм|цитрус|грейпфрут", "Цитрус"),
    ("персик|абрикос|нектарин", "Персик"),
    ("яблок|груш", "Яблоко и груша"),
    ("цветоч|белых цветов|роза|лаванд", "Белые цветы"),
    ("миндал|орех|пралине", "Миндаль"),
    ("ягод|вишн|слив|смород", "Красные ягоды"),
    ("ванил|дуб|карамел", "Ваниль и дуб"),
    ("трав|зелён|зелен|мят|перец", "Травы и специи"),
]
DEFAULT_AROMA = {"red": "Красные ягоды", "orange": "Цедра и специи", "rose": "Ягоды", "white": "Свежие фрукты"}
# Colour patterns and swatches, in order.
SWATCHES = [
    ("оранж", "#f6c08d", "#e38a47"), ("янтар|коньяч", "#f3c97c", "#d9923a"), ("золот", "#f8e7a8", "#e9c86a"), ("лимон|желт|жёлт", "#fbf5c4", "#efe59a"),
    ("соломен|бел|прозрач", "#fcf8dc", "#efe8bd"), ("лосос", "#fbd3c0", "#f0a78c"), ("розов", "#fbd5d8", "#ee9fae"), ("кирпич", "#c46a4b", "#933f2a"),
    ("вишн", "#95243a", "#5e1022"), ("фиолет|пурпур", "#76224b", "#45102c"), ("гранат", "#8f2130", "#58101d"), ("рубин|красн", "#a92b40", "#6d1426"),
]
# Upload types and container brands.
MIMES = ["image/jpeg", "image/jpg", "image/pjpeg", "image/png", "image/webp", "image/heic", "image/heif", "image/heic-sequence", "image/heif-sequence", "image/avif"]
HEIF_BRANDS = ["heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1", "heif"]
AVIF_BRANDS = ["avif", "avis", "MA1A", "MA1B"]
