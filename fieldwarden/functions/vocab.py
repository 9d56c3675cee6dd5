"""Closed vocabularies and vector layout of the detector."""

from __future__ import annotations

# ---- Fixed values (must equal the published model contract) -----------------

PAD, UNK, EOS = "<PAD>", "<UNK>", "<EOS>"
PAD_ID, UNK_ID, EOS_ID = 0, 1, 2
FIRST_TOKEN_ID = 3

PORTS = [
    "1433", "1521", "2181", "3306", "3307", "3308", "3309", "3310", "3358", "5088", "8020", "27017",
    "27018", "27019", "49638", "51899",
]
DATABASE_TYPES = [
    "DEL-MYSQL", "FILE", "HBASE", "HIVE", "JDMETA", "JRDW", "JREP", "JRTC", "MONGODB", "MYSQL",
    "ORACLE", "SQLSERVER", "TEXT",
]
THEMES = [
    "APP", "京东商城", "众筹", "供应链金融", "保障险", "其他", "农村金融", "外部数据", "客服", "市场", "支付", "流量", "消费金融", "理财",
    "用户生态", "财务", "账户融合", "风控",
]
COLUMN_TYPES = [
    "BIGINT", "CHAR", "DATETIME", "DECIMAL", "DOUBLE", "INT", "NUMBER", "STRING", "TIMESTAMP",
    "TINYINT", "VARCHAR", "VARCHAR2",
]
FLAGS = ["1", "0"]

INSENSITIVE = "非敏感"
SENSITIVE_TYPES = ["卡号", "固定电话", "地址", "姓名", "手机", "身份证", "邮箱"]
# the older label table, kept for callers that still hold such labels
LEGACY_UNKNOWN = "UNKNOWN"
LEGACY_SENSITIVE_TYPES = ["身份证", "姓名", "地址", "手机", "卡号", "其他", "固定电话", "邮箱", "京东PIN"]

# labels that the training set leaves out
UNCLEAN_TYPES = ["0", "1", "京东pin", "其他"]
# lumped category of rare column types
OTHER = "其他"

MAX_LEN = {
    "database_name": 25,
    "database_comment": 10,
    "table_name": 60,
    "table_comment": 25,
    "column_name": 30,
    "column_comment": 30,
    "column_value": 50,
}

# majority classes weigh 1, the others this much more
CLASS_WEIGHT_RATIO = 40

STATUS_OK, STATUS_BAD_REQUEST = 200, 301

# ---- Derived ----------------------------------------------------------------


def with_default(values: list[str], default: str) -> list[str]:
    """One-hot order: code-point order of the valid values and their default."""
    return sorted([*values, default])


CATEGORIES = {
    "database_port": (with_default(PORTS, "PORT_DEFAULT"), "PORT_DEFAULT"),
    "database_type": (with_default(DATABASE_TYPES, "DATABASE_TYPE_DEFAULT"), "DATABASE_TYPE_DEFAULT"),
    "database_is_shard": (
        with_default(FLAGS, "DATABASE_IS_SHARD_DEFAULT"),
        "DATABASE_IS_SHARD_DEFAULT",
    ),
    "table_theme": (with_default(THEMES, "TABLE_THEME_DEFAULT"), "TABLE_THEME_DEFAULT"),
    "column_type": (with_default(COLUMN_TYPES, "COLUMN_TYPE_DEFAULT"), "COLUMN_TYPE_DEFAULT"),
    "column_is_primary_key": (
        with_default(FLAGS, "COLUMN_IS_PRIMARY_KEY_DEFAULT"),
        "COLUMN_IS_PRIMARY_KEY_DEFAULT",
    ),
    "column_allow_null": (
        with_default(FLAGS, "COLUMN_ALLOW_NULL_DEFAULT"),
        "COLUMN_ALLOW_NULL_DEFAULT",
    ),
}

# order of the blocks in the wide vector: a category name or a text field (its length)
WIDE_LAYOUT = [
    "database_port",
    "database_name",
    "database_comment",
    "database_type",
    "database_is_shard",
    "table_name",
    "table_comment",
    "table_theme",
    "column_name",
    "column_comment",
    "column_type",
    "column_is_primary_key",
    "column_allow_null",
    "column_value",
]
DEEP_LAYOUT = list(MAX_LEN)

WIDE_SIZE = sum(len(CATEGORIES[f][0]) if f in CATEGORIES else 1 for f in WIDE_LAYOUT)
DEEP_SIZE = sum(MAX_LEN.values())

CLASSES = sorted([*SENSITIVE_TYPES, INSENSITIVE])
LEGACY_CLASSES = sorted([*LEGACY_SENSITIVE_TYPES, INSENSITIVE, LEGACY_UNKNOWN])

# the request fields besides the value list
REQUEST_FIELDS = [f for f in WIDE_LAYOUT if f != "column_value"]

META_FIELDS = [
    "stage_table_name",
    "stage_column_name",
    "database_uri",
    *REQUEST_FIELDS,
    "column_is_sensitive",
    "column_sensitive_type",
]
VALUE_FIELDS = [
    "stage_table_name",
    "stage_column_name",
    "column_value",
    "column_is_sensitive",
    "column_sensitive_type",
]
KEY = ["stage_table_name", "stage_column_name"]

# meta fields whose characters feed the dictionary
DICTIONARY_META_FIELDS = [
    "database_name",
    "database_comment",
    "table_name",
    "table_comment",
    "table_theme",
    "column_name",
    "column_comment",
]
