"""Fixed values that results depend on: limits, keywords, patterns, script ranges, dialect marks."""

HEAD_BYTES = 65536
HEAD_LINES = 20
ACCEPT = 0.5
LOW_CONFIDENCE = 0.7
BINARY_SHARE = 0.3
FREE_TEXT_LENGTH = 100

PII_KEYS = r"\b(name|phone|email|mail|id_card|idcard|ssn|social.security|address|addr|passport|birth|birthday|gender|sex|mobile|tel|telephone|contact|身份证|姓名|电话|邮箱|地址|密码|手机|生日|性别|年龄|籍贯|民族|住址|card_no|cardno|bank|account|credit|ip_addr|mac|imei|uuid|token|secret|password|passwd|pwd)\b"
PII_TYPES = [
    ("name|姓名|名字", "person_name"),
    ("phone|mobile|tel|电话|手机|telephone|contact", "phone_number"),
    ("email|mail|邮箱", "email"),
    ("id_card|idcard|身份证|card_no|cardno|ssn", "id_card"),
    ("address|addr|地址|住址", "address"),
    ("birth|birthday|生日", "birth_date"),
    ("gender|sex|性别", "gender"),
    ("age|年龄", "age"),
    ("passport", "passport"),
    ("密码|password|passwd|pwd|secret|token", "credential"),
    ("bank|account|credit", "financial"),
    ("ip_addr|mac|imei|uuid", "device_id"),
    ("province|city|district|省|市|区|籍贯|民族", "demographic"),
]

SQL_KEYWORD = r"\b(create\s+table|insert\s+into|drop\s+table|alter\s+table|create\s+index|select\s+.+\s+from|update\s+.+\s+set|delete\s+from)\b"
SQL_START = r"(create\s+table|insert\s+into|drop\s+table|alter\s+table|create\s+index)"
LOG_WEAK = r"^\s*[\[\(]?\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}|\b(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b|^\d{2}:\d{2}:\d{2}"
LOG_TIME = r"^\s*[\[\(]?\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}|^\s*[\[\(]?\d{2}:\d{2}:\d{2}"
LOG_LEVEL = r"\b(INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b"
PUNCTUATION = "[。，？！、；：,.!?;:]"

SCRIPTS = {
    "Latin": [(0x0041, 0x005A), (0x0061, 0x007A), (0x00C0, 0x024F), (0x1E00, 0x1EFF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "Greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x0400, 0x052F)],
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Hiragana": [(0x3040, 0x309F)],
    "Katakana": [(0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2EBEF)],
}

DIALECTS = {
    "mysql": [(r"`", 1), (r"\bAUTO_INCREMENT\b", 2), (r"\bENGINE\s*=", 2), (r"/\*!", 2), (r"\bDEFAULT\s+CHARSET\b", 2), (r"\bLOCK\s+TABLES\b", 1)],
    "postgres": [(r"\$\$|\$[A-Za-z_]\w*\$", 2), (r"\bCOPY\b[^\n;]*\bFROM\s+stdin\b", 3), (r"^\\\.\s*$", 2), (r"\bOWNER\s+TO\b", 2), (r"\bpg_catalog\b", 2), (r"::\w", 1), (r"\bnextval\s*\(", 1), (r"\bSET\s+search_path\b", 2)],
    "tsql": [(r"\[[A-Za-z_]\w*\]", 1), (r"^\s*GO\s*$", 2), (r"\bIDENTITY\s*\(", 2), (r"\bNVARCHAR\b", 1), (r"\bSET\s+(?:ANSI_NULLS|QUOTED_IDENTIFIER)\b", 2), (r"\bUSE\s+\[", 1)],
    "sqlite": [(r"\bPRAGMA\b", 2), (r"\bAUTOINCREMENT\b", 2), (r"\bsqlite_sequence\b", 2), (r"\bWITHOUT\s+ROWID\b", 2), (r"\bBEGIN\s+TRANSACTION\b", 1)],
    "oracle": [(r"\bVARCHAR2\b", 2), (r"\bNUMBER\s*\(", 1), (r"\bNVL\s*\(", 1), (r"\bSYSDATE\b", 1), (r"\bFROM\s+DUAL\b", 2), (r"\bCREATE\s+OR\s+REPLACE\b", 1)],
}

#: First rule of which one mark occurs in the lower-cased message; "other" if none does.
JSON_ERRORS = [
    ("trailing_comma", ("trailing comma", "expecting property name")),
    ("single_quotes", ("single quote", "expecting value")),
    ("comments", ("comment",)),
    ("unclosed_string", ("unterminated string",)),
    ("incomplete", ("expecting",)),
]
EXAMPLE_BUDGET, EXAMPLE_MOST, EXAMPLE_LEAST = 2400, 48, 6
UNSTEADY = 0.5
