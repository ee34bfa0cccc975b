"""Regular expressions of the engine, spelt for Java and Python alike unless said otherwise."""

# Results depend on these ranges, patterns and boundaries as they stand.
HAN = r"[\x{4e00}-\x{9fff}]"
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
CJK_PY = "\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff\u3000-\u303f\uff00-\uffef"
LATIN = r"[A-Za-z]"
PREFIX = "__ITRANSLATE_"
PLACEHOLDER = r"__ITRANSLATE_[A-Z]\d{4,}_"
ANY_PLACEHOLDER = r"__IT[A-Za-z0-9]{0,16}_[A-Z]\d{4,}_"
IDENTIFIERS = {
    "url": r"(?i)https?://[^\s<>\"']+",
    "www": r"(?i)www\.[^\s<>\"']+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "product_code": r"\b[A-Z]{2,6}-\d{2,}[A-Z0-9-]*\b",
    "interface": r"(?i)\bUSB-C\b|\bHDMI\b|\bBluetooth\b|\bWi-Fi\b",
    "version": r"(?i)\bWindows\s*\d+(?:\.\d+)?\b",
    "version_num": r"\b\d+\.\d+(?:\.\d+)+\b",
    "measurement": r"(?i)\b\d+(?:\.\d+)?\s*(?:mm|cm|m|kg|g|ml|L|W|V|A|mAh|Wh|GHz|MHz|%)\b",
    "model_no": r"\b[A-Z]{2,4}[- ]?\d{3,}[A-Z0-9-]*\b",
}
ENTITY = r"&(?:#[0-9]{1,8}(?:;|(?![A-Za-z0-9]))|#[xX][0-9a-fA-F]{1,8}(?:;|(?![A-Za-z0-9]))|[A-Za-z][A-Za-z0-9]{0,31}(?:;|(?![A-Za-z0-9])))"
SCAFFOLDING = r"(?i)^\s*(this (is|product)|it is)\b"
SENTENCE_ENDS, CLAUSE_ENDS = "。！？；!?;…", "，,：:、"

CONTENT_TOKEN = HAN + r"|[A-Za-z0-9'_-]+"
WORD = r"(?U)\w+(?:[-']\w+)*"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What every identifier has some of; most texts have none, and need no closer look.
HINT = r"(?iU)\d|@|www\.|https?://|usb-c|hdmi|bluetooth|wi-fi"
