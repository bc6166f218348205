"""Patterns, word lists and formats that results must agree on."""

# Validity patterns.
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
PHONE = r"^(\+?(84|1|44)|0)?[\s.-]?\(?\d{2,4}\)?([\s.-]?\d{3,4}){2,3}$"
URL = r"^https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+"

# Words in column names that point to a role.
NAME_TERMS = {
    "id": r"\b(id|uuid|guid|key|code|sku|_id|index)\b",
    "gender": r"\b(gender|sex|male|female|nam|nữ|boy|girl|man|woman|m|f|men|women)\b",
    "email": r"\b(e[-_]?mail|email|mail)\b",
    "phone": r"\b(phone|tel|mobile|cell|số[\s_]?điện[\s_]?thoại)\b",
    "address": r"\b(address|addr|street|road|avenue|drive|lane|place|city|town|country|postcode|state|zip|postal|địa[\s_]?chỉ|đường|phố|quận|huyện|tỉnh|thành[\s_]?phố|phường|xã)\b",
    "name": r"\b(name|first[\s_]?name|last[\s_]?name|full[\s_]?name|tên|họ|họ[\s_]?tên|họ[\s_]?và[\s_]?tên)\b",
    "url": r"\b(url|link|website|site|web)\b",
    "range": r"\b(range|interval|period|between|from|to|duration|time|span|length|distance|limit|min(imum)?|max(imum)?|bounds|threshold)\b",
    "likert": r"(scale|rating|score|satisfaction|agreement|level|thang[\s_]?đo|đánh[\s_]?giá|mức[\s_]?độ|hài[\s_]?lòng|đồng[\s_]?ý)",
    "non_negative": r"\b(age|height|weight|duration|time(_(spent|elapsed|taken|sec|secs|second|seconds|min|mins|minute|minutes|hr|hrs|hour|hours))?|timestamp|year|years|day|days|month|months|week|weeks|score|count|total|quantity|amount|size|distance|length)\b",
}
DATE_TERMS = ["date", "time", "day", "month", "year", "createdAt", "updatedAt", "ngày", "tháng", "năm"]

# Spellings of true and false.
TRUE_WORDS = ["1", "1.0", "yes", "y", "true", "t", "có", "co", "đúng", "dung", "ok", "agree", "approved", "success", "pass",
              "đồng ý", "dong y", "chấp nhận", "chap nhan"]
FALSE_WORDS = ["0", "0.0", "no", "n", "false", "f", "không", "khong", "sai", "reject", "fail", "denied", "cancel",
               "từ chối", "tu choi", "hủy", "huy", "none"]
BOOLEAN_TRIGGERS = ["yes", "no", "true", "false", "có", "không"]
BOOLEAN_TRUE = ["yes", "y", "true", "t", "1", "1.0", "có", "co", "đúng", "dung", "ok"]
BOOLEAN_FALSE = ["no", "n", "false", "f", "0", "0.0", "không", "khong", "sai", "none"]

# Address patterns (group, weight, pattern), matched on lower-case text.
ADDRESS_PATTERNS = [
    ("us", 2, r"(?:^|\s)\d+\s+[a-z0-9\s]+(?:\s|,|$)"),
    ("us", 3, r"(?:^|\s)\d{5}(?:-\d{4})?(?:\s|,|$)"),
    ("us", 1, r"(?:^|\s)[a-z]{2}(?:\s|,|$)"),
    ("uk", 3, r"[a-z]{1,2}[0-9][a-z0-9]?\s?[0-9][a-z]{2}"),
    ("vn", 2, r"(?:quận|huyện)\s+[0-9a-zà-ỹ\s]+"),
    ("vn", 2, r"(?:phường|xã)\s+[0-9a-zà-ỹ\s]+"),
    ("vn", 2, r"(?:tỉnh|thành phố|tp\.?)\s+[a-zà-ỹ\s]+"),
]
HOUSE_NUMBER = r"(?:^|\s)\d+\s+[a-zà-ỹ]+"

# Interval wording.
HYPHEN_RANGE = r"\d+\s*[-–—]\s*\d+"
TO_RANGE = r"\d+\s+(?:to|đến)\s+\d+"
COMPARISONS = [
    r"(?:less|fewer|smaller|lower)\s+than\s+\d+",
    r"(?:nhỏ|ít|thấp)\s+(?:hơn|dưới)\s+\d+",
    r"(?:more|greater|larger|higher|bigger)\s+than\s+\d+",
    r"(?:lớn|nhiều|cao)\s+(?:hơn|trên)\s+\d+",
    r"(?:less|fewer|smaller|lower)\s+than\s+(?:or\s+equal\s+to\s+)?\d+",
    r"(?:maximum|max|up to|not more than|no more than|at most)\s+\d+",
    r"(?:không\s+quá|tối\s+đa|nhiều\s+nhất|cao\s+nhất)\s+\d+",
    r"(?:more|greater|larger|higher)\s+than\s+(?:or\s+equal\s+to\s+)?\d+",
    r"(?:minimum|min|at least|no less than|not less than)\s+\d+",
    r"(?:ít\s+nhất|tối\s+thiểu|thấp\s+nhất)\s+\d+",
    r"between\s+\d+\s+and\s+\d+",
    r"(?:trong\s+khoảng|trong\s+phạm\s+vi|giữa)\s+\d+\s+(?:và|và\s+giữa|đến)\s+\d+",
    r"[<≤]\s*\d+",
    r"[>≥]\s*\d+",
    r"\d+\s*[<≤]\s*[^<>≤≥]+\s*[<≤]\s*\d+",
    r"from\s+\d+\s+(?:upwards|up|and\s+above)?",
    r"từ\s+\d+\s+(?:trở\s+lên|trở\s+đi)?",
]
UNITS = ["percent", "%", "kg", "g", "lb", "oz", "m", "km", "cm", "mm", "inch", "ft", "liter", "ml", "hour", "minute", "second",
         "day", "week", "month", "year", "vnd", "usd", "eur", "$", "€", "₫", "đồng", "dollar"]

# Date formats in order of preference (strptime spelling).
DATE_FORMATS = [
    "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%Y/%m/%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S",
    "%d.%m.%Y", "%m.%d.%Y", "%d %b %Y", "%b %d %Y", "%d-%m-%Y %H:%M:%S", "%m-%d-%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S",
    "%m/%d/%Y %H:%M:%S", "%Y-%b-%d", "%Y %b %d", "%Y", "%Y-%m", "%m-%Y", "%d-%m-%y", "%m-%d-%y", "%d/%m/%y", "%m/%d/%y",
    "%d.%m.%y", "%m.%d.%y", "%d %b %y", "%b %d %y", "%d %B %Y", "%B %d %Y", "%Y %B %d", "%d-%b-%y", "%d-%b-%Y",
]

# Month names, January to December.
MONTH_NAMES = [
    ["january", "jan", "tháng một", "th1", "janvier", "janv"],
    ["february", "feb", "tháng hai", "th2", "février", "févr"],
    ["march", "mar", "tháng ba", "th3", "mars"],
    ["april", "apr", "tháng tư", "th4", "avril", "avr"],
    ["may", "tháng năm", "th5", "mai"],
    ["june", "jun", "tháng sáu", "th6", "juin"],
    ["july", "jul", "tháng bảy", "th7", "juillet", "juil"],
    ["august", "aug", "tháng tám", "th8", "août"],
    ["september", "sep", "tháng chín", "th9", "septembre", "sept"],
    ["october", "oct", "tháng mười", "th10", "octobre"],
    ["november", "nov", "tháng mười một", "th11", "novembre"],
    ["december", "dec", "tháng mười hai", "th12", "décembre", "déc"],
]

# Gender words.
MALE_WORDS = ["male", "m", "man", "boy", "nam", "men"]
FEMALE_WORDS = ["female", "f", "woman", "girl", "nữ", "women"]
