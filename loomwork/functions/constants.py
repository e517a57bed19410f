"""Word lists, patterns, maps and thresholds that results depend on. Kept as text, in their natural order."""

# Fixed: secrets that must not reach a training set. The last is for large-corpus preparation only.
SECRETS = [
    r"sk-[A-Za-z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"ghp_[A-Za-z0-9]{30,}",
    r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*['\"][A-Za-z0-9_\-]{16,}['\"]",
    r"Bearer\s+[A-Za-z0-9_\-\.]{25,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"KGAT_[A-Za-z0-9]{20,}",
]
# Fixed: template leftovers; preparation and metrics each have their own pattern.
PREP_PLACEHOLDER = r"\{\{?\s*\w+\s*\}?\}|\[[نام توضیح موضوع]\]|<نام>|TODO|Lorem ipsum"
METRIC_PLACEHOLDER = r"\{\{\s*\w+\s*\}\}|<نام>|\[نام\]|Lorem ipsum|\bTODO\b"
METRIC_MARKS = ["{{", "<نام>", "[نام]", "Lorem ipsum", "TODO"]  # one of them is in all that METRIC_PLACEHOLDER matches
# Fixed: ends of an unfinished answer.
UNFINISHED = ["،", ",", ":", "؛", " و", " یا", " که", " برای"]
# Fixed: substrings counted as signs of Arabic and of Persian, and letters that only Persian has.
ARABIC_MARKERS = ["في", "من", "على", "هذا", "هذه", "التي", "الذي", "ذلك", "تلك", "كما", "بينما", "إن", "أو", "لقد", "قد", "عندما", "حيث", "إلى", "التى", "كان", "يجب أن", "لكن", "كل", "بعض", "هناك"]
PERSIAN_MARKERS = ["است", "را", "برای", "که", "های", "هاي", "بود", "هستند", "نیست", "می\u200c", "نمی\u200c", "خیلی", "بسیار", "این", "آن", "با", "تا", "اما", "هم", "یک", "شود", "شد", "می\u200cشود", "خود", "کرد", "کند", "باشد", "چگونه", "چطور", "چه", "هر"]
PERSIAN_LETTERS = "یکگپچژ"
# Fixed: function words of the token classifier.
ARABIC_WORDS = ["في", "من", "على", "هذا", "هذه", "التي", "الذي", "ذلك", "تلك", "كما", "بينما", "إن", "لقد", "عندما", "حيث", "إلى", "كان", "لكن", "هناك", "أو", "وقد", "فقد", "ثم", "أي", "ما", "لا", "هو", "هي"]
PERSIAN_WORDS = ["است", "را", "برای", "که", "های", "بود", "هستند", "نیست", "خیلی", "بسیار", "این", "آن", "با", "تا", "اما", "هم", "یک", "شود", "شد", "خود", "کرد", "کند", "باشد", "چگونه", "چطور", "چه", "هر", "هایی", "باید", "دارد"]
# Fixed: letters and digits that normalization maps; the last source letter (tatweel) has no target and is dropped.
MAP_FROM = "يىكةٱ" + "".join(chr(0x0660 + i) for i in range(10)) + "ـ"
MAP_TO = "ییکها" + "".join(chr(0x06F0 + i) for i in range(10))
# Fixed: marks of direction and controls that normalization drops.
BIDI = "[\u200b\u200e\u200f\u202a-\u202e\u2066-\u2069\ufeff]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
# Fixed: what normalization leaves alone, in order of priority.
PROTECTED = [
    r"```[\s\S]*?(?:```|$)",
    r"`[^`\n]+`",
    r"(?i:https?://|www\.)[^\s\"'<>]+",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"(?:~|\.{1,2})?/[A-Za-z0-9._~+\-][A-Za-z0-9._~/+\-]*|[A-Za-z]:\\(?:[A-Za-z0-9._~+\-]+\\?)+",
    r"[A-Za-z0-9_\-+=*/<>{}()[\];:,.\"'&|!?#$%^~\\ ]{4,}",
]
# Fixed: vocabulary of relevance, marks of unfinished work, and words that ask for a page.
RELEVANCE = ["html", "css", "javascript", "js", "div", "flex", "grid", "display", "font", "color", "margin", "padding", "selector", "style", "script", "class", "element", "browser", "responsive", "media", "برچسب", "استایل", "طراحی", "صفحه", "کد", "المان", "ریسپانسیو", "مرورگر", "چیدمان", "فونت"]
BAD_MARKERS = ["TODO", "FIXME", "implement this yourself", "placeholder logic", "... rest of the code"]
BUILD_WORDS = ["بساز", "build", "create", "make", "generate", "landing", "dashboard", "page"]
# Fixed: elements without an end tag.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
# Fixed: fenced blocks, what their language tags mean, bold paths before them and the names of blocks without one.
BLOCK = r"```([a-zA-Z0-9]*)\s*\n([\s\S]*?)```"
BLOCK_KIND = {"html": "html", "css": "css", "js": "js", "javascript": "js", "jsx": "js", "json": "other", "text": "other"}
BOLD_PATH = r"\*\*\s*([\w./\-]+)\*\*"
FILE_NAMES = {"html": "index.html", "css": "styles.css", "js": "app.js", "javascript": "app.js"}
# Fixed: thresholds of large-corpus preparation.
LIMITS = {"min_answer_chars": 60, "min_prompt_chars": 10, "max_answer_chars": 4000, "max_seq_len": 3072}
