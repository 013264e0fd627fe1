"""Keyword and pattern tables of the text rules, as data."""

from __future__ import annotations

# --- Fixed values: segment words -------------------------------------------------
TARGET_SEGMENTS = (
    "office", "retail", "showroom", "business_center",
    "street_retail", "building", "free_purpose",
)
EXCLUDED_TYPES = ("warehouse", "industrial", "land_commercial", "logistics", "garage")

EXCLUDE_WORDS = (
    "склад", "warehouse", "логіст", "логист", "виробниц", "производств", "промислов",
    "промышлен", "industrial", "цех", "ангар", "завод", "ділянка", "участок", "земл",
    "гараж", "паркоміс", "паркинг", "parking", "автосервіс", "автосервис", "с/г",
    "сільськогосподар",
)
# Counted only as a word of its own; inside longer words it means nothing.
EXCLUDE_WHOLE_WORDS = ("сто",)
EXCLUDE_UNLESS = ("офіс", "офис", "office", "шоурум", "бц")

URL_OFFICE = ("ofis", "office", "офис")
URL_SHOWROOM = ("showroom", "шоурум")
SHOWROOM_WORDS = ("шоурум", "showroom", "show-room")
BUSINESS_CENTER_WORDS = ("бізнес-центр", "бизнес-центр", "бізнес центр", "бизнес центр")
BUILDING_WORDS = ("окрема будівля", "отдельно стоящ", "окремо стояч")
OFFICE_WORDS = ("офіс", "офис", "office")
RETAIL_WORDS = ("торгов", "магазин", "рітейл", "ритейл", "retail")
FACADE_WORDS = ("фасад", "1 поверх", "перший поверх", "первый этаж")
FIRST_FLOOR_WORDS = (
    "комерційн", "коммерческ", "приміщення", "помещение", "вільного", "свободного",
)
TARGET_WORDS = (
    "офіс", "офис", "office", "шоурум", "showroom", "show-room", "торгов", "магазин",
    "рітейл", "ритейл", "retail", "бізнес-центр", "бизнес-центр", "бізнес центр",
    "бизнес центр", "бц ", " бц", "фасад", "1 поверх", "1-й поверх", "перший поверх",
    "первый этаж", "street retail", "окрема будівля", "отдельно стоящ", "окремо стояч",
    "вільного призначення", "свободного назначения", "комерційн", "коммерческ",
    "приміщення", "помещение",
)

# --- Fixed values: property type guess, in order ---------------------------------
GUESS_OFFICE = ("офіс", "офис", "office", "ofis")
GUESS_WAREHOUSE = ("склад", "warehouse", "логіст", "логист", "ангар")
GUESS_RETAIL = ("торг", "магазин", "рітейл", "ритейл", "retail")
GUESS_STREET = ("1 поверх", "перший поверх", "первый этаж", "фасад")
GUESS_INDUSTRIAL = ("вироб", "промисл", "industrial", "цех", "завод")
GUESS_LAND = ("земл", "ділянка", "участок", "land")
GUESS_FREE = ("вільного призначення", "свободного назначения", "free")

# --- Fixed values: districts ------------------------------------------------------
# name, label in the second language
DISTRICTS = (
    ("Печерський", "Печерский"),
    ("Шевченківський", "Шевченковский"),
    ("Голосіївський", "Голосеевский"),
    ("Подільський", "Подольский"),
    ("Дарницький", "Дарницкий"),
    ("Дніпровський", "Днепровский"),
    ("Солом'янський", "Соломенский"),
    ("Оболонський", "Оболонский"),
    ("Святошинський", "Святошинский"),
    ("Деснянський", "Деснянский"),
)
DISTRICT_STEMS = (
    ("печерск", "Печерський"),
    ("печерськ", "Печерський"),
    ("шевченк", "Шевченківський"),
    ("голосеев", "Голосіївський"),
    ("голосіїв", "Голосіївський"),
    ("подол", "Подільський"),
    ("поділь", "Подільський"),
    ("дарниц", "Дарницький"),
    ("днепр", "Дніпровський"),
    ("дніпр", "Дніпровський"),
    ("соломен", "Солом'янський"),
    ("солом", "Солом'янський"),
    ("оболон", "Оболонський"),
    ("святошин", "Святошинський"),
    ("деснян", "Деснянський"),
)
DISTRICT_MENTION = (
    r"(?iuU)(Печерськ\w*|Шевченківськ\w*|Голосіївськ\w*|Подільськ\w*|Дарницьк\w*|"
    r"Дніпровськ\w*|Солом['’]?янськ\w*|Оболонськ\w*|Святошинськ\w*|Деснянськ\w*)"
)
CITY_NAMES = ("київ", "киев", "kyiv")

# --- Fixed values: region slugs of listing urls -----------------------------------
REGION_FOREIGN = (
    "lvov", "lviv", "odessa", "odesa", "kharkov", "kharkiv", "dnipro", "dnepr",
    "vinnitsa", "vinnyts", "ternopol", "ternopil", "ivano", "uzhgorod", "chernovts",
    "chernigov", "chernihiv", "poltava", "zaporozh", "zaporizh", "nikolaev", "mykolaiv",
    "krivoy", "kryvyi", "rovno", "rivne", "lutsk", "sumy", "zhytomyr", "khmeln",
    "cherkass", "kropivn", "kropyvnytskyi", "mariupol", "kherson",
)
REGION_LOCAL = (
    "kiev", "kyiv", "киев", "київ", "brovary", "irpen", "irpin", "bucha", "vyshneve",
    "boyarka", "obukhov", "borschagov", "borshchahiv", "sofievsk", "sofiivsk",
    "petropavlovsk", "vyshenki", "hatne", "glevakha", "kotsyubinsk", "kotsiubyns",
)

# --- Fixed values: block pages -----------------------------------------------------
BLOCK_MARKERS = (
    "cf-browser-verification", "cf-challenge", "just a moment", "attention required",
    "access denied", "request blocked", "captcha", "cloudflare",
    "проверка безопасности", "доступ ограничен", "generated by cloudfront",
)
# own choice: share of the visible text of a page
BLOCK_SHARE = 0.02

# --- Fixed values: phones ----------------------------------------------------------
PHONE_PREFIXES = (
    "039", "050", "063", "066", "067", "068", "073", "091", "092",
    "093", "094", "095", "096", "097", "098", "099", "044",
)
_OPERATORS = "|".join(p[1:] for p in PHONE_PREFIXES)
PHONE_PATTERNS = (
    rf"(?i)((?=[+(03])(?<![\d.])(?:\+?38[\s\-]?)?\(?(?:0(?:{_OPERATORS}))\)?[\s\-]?\d{{3}}[\s\-]?\d{{2}}[\s\-]?\d{{2}}(?![\d.]))",
    r"(?i)tel:([+\d\-\s()]+)",
    r"(?i)number=%2B(380\d{9})",
    rf"((?=380)(?<!\d)380(?:{_OPERATORS})\d{{7}}(?!\d))",
)

# --- Fixed values: page status -----------------------------------------------------
STATUS_SOLD_PATTERN = r"(?=[поw])(?<![\p{L}\p{N}_])(продано|об.?єкт продано|объект продан|was sold)(?![\p{L}\p{N}_])"
STATUS_RENTED_PATTERN = r"(?=[зоаrl])(?<![\p{L}\p{N}_])(здано|здано в оренду|орендовано|арендовано|rented|leased)(?![\p{L}\p{N}_])"
STATUS_INACTIVE_WORDS = (
    "оголошення неактуальне", "объявление неактуально", "знято з публікації",
    "оголошення видалено", "объявление удалено",
)
# raw status words -> listing status, in order
STATUS_WORDS = (
    ("sold_marked", ("sold", "продано")),
    ("rented_marked", ("rented", "здано", "арендовано", "орендовано")),
    ("vanished", ("inactive", "404", "unavailable", "архів", "архив")),
)
EXPLICIT_DEAL_WORDS = ("продано", "sold", "здано", "арендовано", "орендовано", "rented")
SOLD_STEMS = ("прода", "sold")
RENTED_STEMS = ("здан", "арендован", "орендован", "rent")

# --- Fixed values: finance terms, OPEX, sellers --------------------------------------
CAP_RATE_PATTERN = (
    r"(?iuU)(?:cap[\s\-]?rate|кап(?:італ)?\.?\s*ставк\w*|капіталізац\w*)"
    r"\s*[:\-]?\s*(\d+(?:[.,]\d+)?)\s*%?"
)
NOI_PATTERN = (
    r"(?iuU)(?:NOI|чистий\s+операц(?:ійний)?\s+дохід|чистый\s+операционн\w*\s+доход)"
    r"\s*[:\-]?\s*(\d{1,3}(?:[ \u00a0]?\d{3})+|\d+(?:[.,]\d+)?)"
)
OPEX_WITHOUT_PATTERN = (
    r"(?iuU)(без\s*(?:opex|опекс)|\+\s*(?:opex|опекс)|(?:opex|опекс)\s*(?:окремо|отдельно)|"
    r"не\s*включа\w*\s*(?:opex|опекс)|netto|net[\s\-]?rent|nnn|triple\s*net|"
    r"чист[аяоїі]*\s*(?:оренд|аренд)|без\s*(?:комунал|коммунал)|"
    r"(?:комуналка|коммуналка)\s*(?:окремо|отдельно)|"
    r"(?:експлуатац|эксплуатац)\w*\s*(?:окремо|отдельно))"
)
OPEX_WITH_PATTERN = (
    r"(?iuU)((?<![А-Яа-яІіЇїЄєҐґA-Za-z])(?:з|с|со)\s*(?:opex|опекс)|"
    r"включа\w*\s*(?:opex|опекс)|включая\s*(?:opex|опекс)|включаючи\s*(?:opex|опекс)|"
    r"включен\w*\s*(?:opex|опекс)|all\s*in(?:clusive)?|все\s*включен|"
    r"грязн\w*\s*(?:оренд|аренд)|gross\s*rent|"
    r"(?<![А-Яа-яІіЇїЄєҐґA-Za-z])(?:з|с)\s*(?:комунал|коммунал)|"
    r"включа\w*\s*(?:комунал|коммунал|експлуатац|эксплуатац)|(?:opex|опекс)\s*включ)"
)
AGENCY_PATTERN = (
    r"(?iu)(агент|ріелтор|риелтор|realtor|broker|АН(?![\p{L}\p{N}_])|агентство|agency|консульт)"
)

# --- Fixed values: addresses ---------------------------------------------------------
ADDRESS_NOISE_PATTERN = (
    r"(?iuU)\b(вул\.?|улица|просп\.?|пр-т|бульвар|б-р|провулок|пер\.?|площа|пл\.?|"
    r"київ|киев|kyiv|київська\s+обл\.?|область)\b"
)
ADDRESS_NON_ALNUM = r"(?iu)[^0-9a-zа-яіїєґ]+"
STREET_PATTERN = (
    r"(?iuU)((?:вул\.|просп\.|пр-т|б-р|улица|проспект)\s+[^\d,]{2,%d},?\s*\d+\w?)"
)
