"""Patterns, word lists, codes and limits.

These must equal the values of the system whose results are matched, so they
are stated plainly and kept together.
"""

from __future__ import annotations

# --- fixed values: built-in masking rules (id, name, pattern, template) -----
BUILTIN_RULES = [
    ("id_card", "身份证号", r"[1-9]\d{5}(18|19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx]", "***IDCARD***"),
    ("phone", "手机号", r"1[3-9]\d{9}", "***PHONE***"),
    ("email", "电子邮箱", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "***EMAIL***"),
    ("bank_card", "银行卡号", r"[1-9]\d{15,18}", "***BANKCARD***"),
    ("ipv4", "IPv4地址", r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)", "***IP***"),
    ("passport", "护照号", r"[A-Za-z][0-9]{8}", "***PASSPORT***"),
    ("chinese_name", "中文姓名", r"[一-龥]{2,4}", "姓名"),
]
DEFAULT_OFF_RULES = ("chinese_name",)
TERMS_RULE_ID = "sensitive_terms"

# Opt-in rule for the older 15-digit identity number.
ID_CARD_15_RULE = ("id_card_15", "15位身份证号", r"[1-9]\d{7}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}", "***IDCARD***")

# --- fixed values: detectors (entity type, pattern) -------------------------
# "\b" is the Unicode word boundary.
DETECTOR_PATTERNS = [
    ("身份证号", r"\b(?:[1-9]\d{7}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}|[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx])\b"),
    ("手机号", r"(?<![0-9])1[3-9]\d{9}(?![0-9])"),
    ("邮箱", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("IP地址", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    ("银行卡号", r"\b\d{16,19}\b"),
    ("护照号", r"\b[EGP]\d{8}\b"),
    ("日期", r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?"),
    ("地名", r"(北京|上海|天津|重庆|河北|山西|辽宁|吉林|黑龙江|江苏|浙江|安徽|福建|江西|山东|河南|湖北|湖南|广东|海南|四川|贵州|云南|陕西|甘肃|青海|台湾|内蒙古|广西|西藏|宁夏|新疆|香港|澳门)(省|市|自治区|特别行政区)?"),
    ("金额", r"[¥$€£]\s?\d+(?:,\d{3})*(?:\.\d{2})?"),
    ("地址", r"[一-龥]{2,}[省市区县镇村][一-龥\d]{2,}[街道路巷号楼室单元][一-龥\d]*"),
]

# --- fixed values: surnames and name hints ----------------------------------
COMMON_SURNAMES = (
    "王 李 张 刘 陈 杨 黄 赵 周 吴 徐 孙 朱 马 胡 郭 林 何 高 梁 郑 罗 宋 谢 唐 韩 曹 许 邓 萧 "
    "冯 曾 程 蔡 彭 潘 袁 于 董 余 苏 叶 吕 魏 蒋 田 杜 丁 沈 姜 范 江 傅 钟 卢 汪 戴 崔 任 陆 "
    "廖 姚 方 金 邱 夏 谭 韦 贾 邹 石 熊 孟 秦 阎 薛 侯 雷 白 龙 段 郝 孔 邵 史 毛 常 万 顾 赖 "
    "武 康 贺 严 尹 钱 施 牛 洪 龚"
).split()
COMPOUND_SURNAMES = "欧阳 司马 上官 诸葛 东方 夏侯 尉迟 公孙 慕容 司徒".split()
NAME_CONTEXT_WORDS = "联系人 负责人 项目负责人 姓名 经理 总监 主任 专员 工程师 联系 对接人 接口人".split()
NAME_STOP_WORDS = (
    "方式 方法 方面 方向 公司 项目 系统 平台 服务 产品 技术 管理 开发 设计 运营 市场 销售 客户 "
    "用户 数据 信息 内容 文件 文档"
).split()
LABELLED_NAME_PATTERNS = [
    r"(?:客户姓名|联系人姓名|联系人|负责人|项目负责人|对接人|接口人|姓名)\s*[:：]\s*([一-龥]{2,4})",
    r"([一-龥]{2,4})(?:先生|女士|老师)",
]

# --- fixed values: entity type aliases --------------------------------------
ENTITY_ALIASES = {
    "姓名": ["姓名", "人名", "中文姓名", "名字"],
    "手机号": ["手机号", "电话", "手机", "电话号码"],
    "邮箱": ["邮箱", "电子邮箱", "email", "Email"],
    "身份证号": ["身份证号", "身份证", "ID"],
    "银行卡号": ["银行卡号", "银行卡", "卡号"],
    "IP地址": ["IP地址", "IP", "ip"],
    "日期": ["日期", "时间", "日期时间"],
    "地址": ["地址", "详细地址", "住址"],
    "地名": ["地名", "地点", "位置"],
    "组织": ["组织", "组织机构", "机构", "公司", "单位", "学校", "大学"],
}

# --- fixed values: finding tokens (type, prefix, suffix, rule id, switch) ----
FINDING_TOKENS = [
    ("身份证号", "***IDCARD", "***", "id_card_ner", "id_card"),
    ("手机号", "***PHONE", "***", "phone_ner", "phone"),
    ("邮箱", "***EMAIL", "***", "email_ner", "email"),
    ("银行卡号", "***BANKCARD", "***", "bank_card_ner", "bank_card"),
    ("IP地址", "***IP", "***", "ipv4_ner", "ipv4"),
    ("护照号", "***PASSPORT", "***", "passport_ner", "passport"),
    ("姓名", "姓名", "", "chinese_name_ner", "chinese_name"),
    ("中文姓名", "姓名", "", "chinese_name_ner", "chinese_name"),
    ("日期", "***DATE", "***", "date_ner", None),
    ("地址", "***ADDRESS", "***", "address_ner", None),
    ("地名", "***LOCATION", "***", "location_ner", None),
    ("组织", "***ORG", "***", "organization_ner", None),
]
FINDING_FALLBACK = ("***SENSITIVE", "***", "unknown_ner", None)

# --- fixed values: default replacement per entity type ----------------------
PICK_LIST_DEFAULTS = {
    "姓名": "姓名", "手机号": "***PHONE***", "邮箱": "***EMAIL***", "身份证号": "***IDCARD***",
    "银行卡号": "***BANKCARD***", "IP地址": "***IP***", "护照号": "***PASSPORT***",
    "地址": "***ADDRESS***", "日期": "***DATE***", "金额": "***AMOUNT***",
}
PICK_LIST_FALLBACK = "***MASKED***"

# --- fixed values: span priority when masking names of files ----------------
NAME_SPAN_PRIORITY = {
    "id_card": 1, "bank_card": 2, "phone": 3, "email": 4, "passport": 5, "ipv4": 6, "chinese_name": 7,
}

# --- fixed values: data classes ---------------------------------------------
DATA_CLASSES = [
    ("C1_PUBLIC", 1, "none"),
    ("C2_INTERNAL", 2, "none (internal masking by business need)"),
    ("C3_SENSITIVE", 3, "at-rest encryption + in-transit TLS1.3 + default-mask when shared"),
    ("C4_CRITICAL", 4, "HSM/KMS + zero-access policy; never logged"),
]
PII_REQUIRED_RULES = ["phone", "id_card", "email", "bank_card", "passport", "address"]
C3_ENTITY_TYPES = ["姓名", "手机号", "身份证号", "邮箱", "银行卡号", "护照号", "地址", "IP地址"]

# --- fixed values: input formats (extension, logical, input, accepted) ------
FORMATS = [
    ("txt", "text", "text", True),
    ("md", "markdown", "markdown", True),
    ("markdown", "markdown", "markdown", True),
    ("csv", "csv", "csv", True),
    ("xls", "excel", "excel", True),
    ("xlsx", "excel", "excel", True),
    ("doc", "word", None, False),
    ("docx", "word", "docx", True),
    ("pdf", "pdf", "pdf", True),
    ("ppt", "powerpoint", "powerpoint", True),
    ("pptx", "powerpoint", "powerpoint", True),
]
# Leading bytes (hex) of binary files that pose as text.
BINARY_MAGIC_HEX = [
    "255044462D",        # PDF
    "504B0304",          # ZIP
    "D0CF11E0",          # OLE2
    "89504E470D0A1A0A",  # PNG
    "474946383761",      # GIF87a
    "474946383961",      # GIF89a
    "52494646",          # RIFF
]

# --- fixed values: limits ----------------------------------------------------
MIB = 1024 * 1024
LIMITS = {
    "csv_bytes": 128 * MIB, "csv_records": 100_000, "csv_columns": 256, "csv_field_bytes": 4 * MIB,
    "sheets": 100, "sheet_rows": 100_000, "sheet_columns": 256, "workbook_cells": 1_000_000, "pages": 1000,
}
BATCH_MAX_FILES = 100
BATCH_MAX_FILE_BYTES = 500 * MIB
BATCH_MAX_BYTES = 2048 * MIB
TERM_MAX_CHARS = 256
CATEGORY_MAX_CHARS = 64
DESCRIPTION_MAX_CHARS = 512
TERM_MAX_ROWS = 10_000
TERM_CSV_HEADER = ["分类", "敏感词", "描述", "状态"]
SHEET_MAX_ROW = 1_048_576
SHEET_MAX_COL = 16_384

# --- fixed values: warnings of extracted documents ---------------------------
FORMULA_CELLS_WARNING = "Formula cells were not recalculated; cached workbook values are preserved."
HIDDEN_SLIDES_WARNING = "Hidden slides were included in extraction."

# --- fixed values: error codes that may be retried ---------------------------
ERROR_CODES = [
    ("INPUT_CORRUPTED", False),
    ("INPUT_NO_CONTENT", False),
    ("INPUT_ENCRYPTED", False),
    ("INPUT_LIMIT_EXCEEDED", False),
    ("INPUT_FORMAT_UNSUPPORTED", False),
    ("OCR_COMPONENT_REQUIRED", True),
    ("OCR_COMPONENT_INVALID", False),
    ("OCR_NO_TEXT", False),
    ("OCR_TIMEOUT", False),
    ("CMAP_AUTH_FAILED", False),
    ("CMAP_VERSION_UNSUPPORTED", False),
    ("CMAP_MISMATCH", True),
    ("PROCESS_INTERRUPTED", False),
]

# --- fixed values: audit vocabulary ------------------------------------------
JOB_EVENT_LEVELS = {
    "Queued": "info", "ProcessingStarted": "info", "Completed": "success", "RetryQueued": "warning",
    "RecoveredInterrupted": "warning", "Failed": "error",
}
RESTORE_EVENT_LEVELS = {"RestoreSucceeded": "success", "RestoreFailed": "error"}
UPLOAD_STATUS_LEVELS = {"success": "success", "failed": "error"}
LOG_LEVELS = ["info", "success", "warning", "error"]
