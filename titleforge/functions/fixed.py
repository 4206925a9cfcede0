"""Letters, word lists and labels that results depend on. Plain text, in one place."""

ZWNJ = "‌"

# Variant letters and the standard letter each becomes.
LETTERS = {
    "ي": "ی",
    "ى": "ی",
    "ۍ": "ی",
    "ې": "ی",
    "ك": "ک",
    "ڪ": "ک",
    "ڬ": "ک",
    "ة": "ه",
    "ۀ": "ه",
    "أ": "ا",
    "إ": "ا",
    "ٱ": "ا",
    "ؤ": "و",
    "ئ": "ی",
}

# Characters of no width, and marks, that vanish (regular expression classes).
NO_WIDTH = r"​‍‎‏⁠﻿"
MARKS = r"ً-ٰٟـؐ-ؚۖ-ۭ"

# All that a normal title may hold; the rest becomes a space.
KEPT = r"ء-غف-يٮ-ۓ۰-۹a-zA-Z0-9٠-٩‌ \t\n"
SPACES = r"[ \t\n\r  - ]+"

# Digits of three scripts, from zero to nine.
FA_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
AR_DIGITS = "٠١٢٣٤٥٦٧٨٩"
EN_DIGITS = "0123456789"

# Words without meaning in a title.
CORE_STOPWORDS = ("دانلود", "خرید", "رایگان", "pdf", "فایل", "کامل", "جدید", "نسخه", "اورجینال")
EXTRA_STOPWORDS = (
    "دانلودی", "رایگانی", "خریدن", "لینک", "مستقیم", "آنلاین", "ورد", "word", "doc", "docx", "zip", "rar",
    "بهترین", "ویژه", "تخفیف", "ارزان", "قیمت", "با", "و", "در", "برای", "به", "از", "ی",
)

# Words before a person's name, before a number, and for an unknown author.
AUTHOR_MARKERS = (
    "از", "نوشته", "اثر", "قلم", "بقلم", "ترجمه", "مترجم", "تالیف", "تألیف", "مولف", "مؤلف", "گردآورنده", "نویسنده", "شاعر", "خواننده",
)
ROLE_MARKERS = ("استاد", "دکتر", "مهندس", "پروفسور")
VOLUME_MARKERS = ("جلد", "پارت", "قسمت", "فصل", "بخش", "سری", "شماره", "دوره", "ترم", "سال")
UNKNOWN_MARKERS = ("ناشناس", "نامشخص", "بینام", "بی‌نام", "بدوننام", "گمنام", "anonymous")

# Phrases that go as a whole, a lone year, and words that spoil a search.
PHRASES = (("پی", "دی", "اف"), ("دانلود", "رایگان"))
YEAR = r"^(1[23]\d{2}|14\d{2}|19\d{2}|20\d{2})$"
QUERY_NOISE = ("اصلی", "اورجینال", "اورژینال", "ارجینال")
QUERY_PREFIXES = ("دانلود", "پی دی اف")

#: A short list of given names; a fuller one comes from a file (``sources.names``).
GIVEN_NAMES = ("آوا", "الناز", "سحر", "مهسا", "زینب", "سارا", "مریم", "علی", "رضا", "محمد", "حسین", "فاطمه", "زهرا", "نگار", "پریسا", "امیر")

# Signs that a page sells a product, surely or perhaps, and that it does not.
STRONG_PRODUCT = (
    r'"@type"\s*:\s*"(?:Product|Offer|AggregateOffer)"',
    r"""itemtype=["']https?://schema\.org/Product""",
    r"""property=["']og:type["'][^>]+content=["']product""",
    r"""content=["']product["'][^>]+property=["']og:type""",
    r"""name=["']product:price:amount""",
    r"""class=["'][^"']*\b(?:single-product|product-page|woocommerce-product)\b""",
    r"""(?:add[-_]to[-_]cart|add-to-basket|data-product[-_]id|product_id=)""",
)
STRONG_REASON = "داده‌ی ساخت‌یافته‌ی محصول"
WEAK_PRODUCT = (
    ("افزودن به سبد", r"افزودن\s+به\s+سبد|به\s+سبد\s+خرید|اضافه\s+به\s+سبد"),
    ("قیمت", r"قیمت\s*[:：]|\bقیمت\b"),
    ("واحد پول", r"[\d۰-۹][\d۰-۹,،٬\s]*\s*(?:تومان|ريال|ریال)"),
    ("خرید", r"خرید\s+(?:محصول|فایل|اشتراک)|همین\s+حالا\s+بخرید|ثبت\s+سفارش"),
    ("دانلود فایل", r"دانلود\s+(?:فایل|محصول)|لینک\s+دانلود"),
    ("موجودی", r"موجود\s+در\s+انبار|ناموجود|اتمام\s+موجودی"),
)
NOT_PRODUCT = (
    ("نوع محتوا مقاله است", r'"@type"\s*:\s*"(?:Article|BlogPosting|NewsArticle|WebPage|AboutPage|ContactPage|CollectionPage|SearchResultsPage)"'),
    ("صفحه‌ی اطلاعات سایت", r"درباره\s*(?:ی)?\s*ما|تماس\s+با\s+ما|قوانین\s+و\s+مقررات|حریم\s+خصوصی|سوالات\s+متداول"),
)
NOT_PRODUCT_PATH = (
    r"/(?:blog|news|article|articles|post|posts|tag|tags|category|categories|about|about-us|contact|contact-us|privacy|terms|faq|"
    r"cart|checkout|my-account|login|register|search|author|page)(?:/|$|\?)"
)
PATH_BLOCKER, EMPTY_BLOCKER = "مسیر URL صفحه‌ی محصول نیست", "صفحه خالی است"
TITLE_SEPARATOR = r"\s*[|–—»«\-:：]\s*"
PUBLISHED = (
    r"""article:published_time["'][^>]+content=["']([^"']+)""",
    r"""["']datePublished["']\s*:\s*["']([^"']+)""",
    r"""article:modified_time["'][^>]+content=["']([^"']+)""",
)

# Labels of the reports.
SUGGEST_LABELS = {"has_suggest": "دارد", "no_suggest": "ندارد", "": "بررسی نشده"}
YES, NO = "بله", "خیر"
REVIEW_MERGE = ("ادغام مبهم", "ابزار مطمئن نبود این عنوان باید با عنوان مشابهی ادغام شود یا نه")
REVIEW_TOPIC = ("ارتباط مرزی با موضوع", "امتیاز موضوعی بین آستانه‌ی رد و آستانه‌ی پذیرش")
SHEETS = {"ready": "آماده تولید محتوا", "archive": "آرشیو آینده", "all": "همه محصولات", "review": "نیاز به بازبینی دستی"}

# Built-in categories with example titles.
CATEGORIES = {
    "jozve": ("جزوه", (
        "جزوه ریاضی عمومی ۱", "جزوه فیزیک پیش‌دانشگاهی", "جزوه شیمی آلی دانشگاهی", "جزوه آمار و احتمال مهندسی",
        "جزوه خانواده پیام نور", "جزوه دست‌نویس مدار منطقی", "جزوه معادلات دیفرانسیل استاد کریمی", "جزوه زیست‌شناسی کنکور",
    )),
    "roman": ("رمان", (
        "رمان شب سرد", "رمان عاشقانه تاوان خیانت", "رمان استاد مغرور", "دانلود رمان دختر شیطون",
        "رمان پلیسی معمایی ایرانی", "رمان عشق ممنوعه جلد دوم", "رمان طنز خنده‌دار", "رمان اجتماعی نویسنده الناز",
    )),
    "ketab": ("کتاب", (
        "کتاب صوتی موفقیت", "کتاب روانشناسی خودشناسی", "کتاب آشپزی ایرانی", "کتاب تاریخ ایران باستان",
        "کتاب مدیریت و کسب و کار", "کتاب شعر حافظ", "کتاب کودک تصویری", "کتاب آموزش زبان انگلیسی",
    )),
    "ketab_darsi": ("کتاب درسی", (
        "کتاب درسی ریاضی هفتم", "کتاب درسی علوم تجربی نهم", "کتاب درسی فارسی دهم", "کتاب درسی عربی یازدهم",
        "کتاب درسی زیست دوازدهم", "کتاب معلم شیمی دهم", "کتاب کار انگلیسی هشتم", "کتاب درسی هندسه یازدهم رشته ریاضی",
    )),
    "ketab_daneshgahi": ("کتاب دانشگاهی", (
        "کتاب مبانی مهندسی برق دانشگاهی", "کتاب حساب دیفرانسیل توماس", "کتاب فیزیک هالیدی جلد اول", "کتاب شیمی عمومی مورتیمر",
        "کتاب اقتصاد خرد دانشگاهی", "کتاب مدارهای الکتریکی بویلستاد", "کتاب مرجع برنامه‌نویسی پایتون دانشگاهی", "کتاب زبان تخصصی مهندسی صنایع",
    )),
    "ketab_daneshamouzi": ("کتاب دانش‌آموزی", (
        "کتاب کمک درسی ریاضی ششم", "کتاب تست زیست کنکور", "کتاب کار و تمرین علوم پنجم", "کتاب جامع کنکور تجربی",
        "کتاب موضوعی شیمی کنکور", "کتاب تیزهوشان ششم به هفتم", "کتاب نکته و تست فیزیک", "کتاب کمک آموزشی فارسی چهارم",
    )),
}

# Titles that belong to no category, against which thresholds are set.
NEGATIVES = (
    "کفش ورزشی مردانه نایک", "گوشی موبایل سامسونگ گلکسی", "تور مسافرتی کیش سه شب", "بیمه شخص ثالث خودرو",
    "قیمت میلگرد آجدار", "استخدام حسابدار در تهران", "اجاره آپارتمان دو خوابه", "دستگاه تصفیه آب خانگی",
    "خرید ارز دیجیتال", "سرویس قابلمه استیل", "لوازم آرایشی اورجینال", "قطعات یدکی پراید",
)
