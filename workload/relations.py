"""Input relations derived from the driver's tables, as SQL both engines read.

``@name@`` stands for a table or another relation. Keys are integers, text is
built with ``||``, CASE and split_part only, so Spark and DuckDB make the same
rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

RELATIONS: dict[str, str] = {}


def pick(values: list[str], index: str) -> str:
    """SQL for the entry of a list at an integer position."""
    listing = "|".join(values).replace("'", "''")
    return f"split_part('{listing}', '|', CAST(({index}) % {len(values)} AS INT) + 1)"


RELATIONS["f_tables"] = """
SELECT
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE
    CASE o_orderkey % 23 WHEN 1 THEN 'tmp_' WHEN 2 THEN 'Temp_' WHEN 3 THEN 's__' ELSE '' END
    || 'stage_t' || CAST(o_orderkey AS STRING)
    || CASE o_orderkey % 11 WHEN 1 THEN '_bak' WHEN 2 THEN '_bak_x' WHEN 3 THEN '_BAK7'
         WHEN 4 THEN '_bk' WHEN 5 THEN '_bk2' WHEN 6 THEN '_20180701' WHEN 7 THEN '_test'
         WHEN 8 THEN '_ok' WHEN 9 THEN '_bakery' ELSE '' END
  END AS table_name,
  CASE WHEN o_orderkey % 5 = 0 THEN 'ods' ELSE 'stage' END AS database_name,
  CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE '1' END AS table_status
FROM @orders@
"""

RELATIONS["f_columns"] = """
SELECT
  'stage_t' || CAST(o_custkey AS STRING) AS table_name,
  CASE WHEN o_orderkey % 4 = 0 THEN 'dt' ELSE 'c' || CAST(o_orderkey AS STRING) END AS column_name,
  CASE WHEN o_orderkey % 5 = 0 THEN 'ods' ELSE 'stage' END AS database_name,
  CASE WHEN o_orderkey % 6 = 0 THEN '0' ELSE '1' END AS column_status
FROM @orders@
"""

RELATIONS["f_labelled"] = """
SELECT
  'stage_t' || CAST(o_custkey AS STRING)
    || CASE WHEN o_orderkey % 17 = 0 THEN '-x' ELSE '' END AS stage_table_name,
  'c' || CAST(o_orderkey AS STRING) AS stage_column_name,
  CASE o_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN '2' ELSE '1' END
    AS column_is_sensitive,
  CASE WHEN o_orderkey % 5 IN (1, 4) THEN """ + pick(
    "姓名 手机 邮箱 地址 京东pin".split(), "o_orderkey"
) + """ ELSE '' END AS column_sensitive_type
FROM @orders@
"""

RELATIONS["f_meta"] = f"""
SELECT
  'S_T' || CAST(c_custkey % 25 AS STRING) AS stage_table_name,
  'C' || CAST(c_custkey AS STRING) AS stage_column_name,
  'db-' || CAST(c_nationkey AS STRING) || '.example.com' AS database_uri,
  {pick("1433 1521 2181 3306 3307 3308 3309 3310 3358 5088 8020 27017 27018 27019 49638 51899 9999".split() + [" 3306 "], "c_custkey")}
    AS database_port,
  CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '  ' || lower(c_mktsegment) || '  '
    ELSE lower(c_mktsegment) || '_' || CAST(c_nationkey AS STRING) END AS database_name,
  CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '客户信息库' WHEN 2 THEN 'N/A' ELSE c_mktsegment END AS database_comment,
  {pick("mysql MYSQL Oracle hive HBASE mongodb sqlserver text file del-mysql jdmeta jrdw jrep jrtc decimal(10,2)".split(), "c_custkey")}
    AS database_type,
  {pick(["1", "0", "", "x"], "c_custkey")} AS database_is_shard,
  CASE WHEN c_custkey % 9 = 0 THEN repeat(lower(c_name), 4)
    ELSE lower(c_name) || '_info' END AS table_name,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '客户主表(' || c_mktsegment || ')'
    ELSE c_mktsegment || ' table, ' || CAST(c_nationkey AS STRING) END AS table_comment,
  {pick("APP 京东商城 众筹 供应链金融 保障险 其他 农村金融 外部数据 客服 市场 支付 流量 消费金融 理财 用户生态 财务 账户融合 风控 未知".split() + [" app "], "c_custkey")}
    AS table_theme,
  CASE WHEN c_custkey % 13 = 0 THEN '_' ELSE 'd:' END || lower(c_name) AS column_name,
  CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '申请人身份证号' WHEN 2 THEN '手机号码，必填'
    WHEN 3 THEN c_mktsegment || ' 地址 of the customer, as it was entered by hand'
    ELSE c_mktsegment END AS column_comment,
  CASE WHEN c_custkey % 211 = 0 THEN 'geometry(point)' WHEN c_custkey % 223 = 0 THEN 'blob'
    ELSE {pick(["varchar(20)", "decimal(10,2)", "int", "string", "datetime", " bigint ", "tinyint(1)", "Varchar(64) "], "c_custkey")}
  END AS column_type,
  {pick(["1", "0", ""], "c_custkey")} AS column_is_primary_key,
  {pick(["0", "1", "1", "", "y"], "c_custkey")} AS column_allow_null,
  CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '1' ELSE '0' END
    AS column_is_sensitive,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN NULL
    WHEN c_custkey % 36 IN (33, 35) THEN NULL
    ELSE {pick("卡号 固定电话 地址 姓名 手机 身份证 邮箱 京东pin 其他 0 1".split(), "c_custkey")} END
    AS column_sensitive_type
FROM @customer@
"""

RELATIONS["f_values"] = """
SELECT
  's_t' || CAST(o_custkey % 25 AS STRING) AS stage_table_name,
  ' c' || CAST(o_custkey AS STRING) || ' ' AS stage_column_name,
  CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 1 THEN CAST(o_orderkey AS STRING) WHEN 2 THEN ''
    WHEN 3 THEN NULL WHEN 4 THEN '  ' || o_orderstatus || '，订单号:' || CAST(o_orderkey * 7919 AS STRING)
    ELSE o_orderpriority || ' ' || md5(CAST(o_orderkey AS STRING)) || ' ' || md5(o_orderpriority) END
    AS column_value,
  CASE WHEN o_custkey % 3 = 0 THEN '1' ELSE '0' END AS column_is_sensitive,
  '' AS column_sensitive_type,
  o_orderkey AS row_id
FROM @orders@
"""

RELATIONS["f_text"] = """
SELECT 'd' || CAST(doc_id AS STRING) AS id, text FROM @documents@
UNION ALL
SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, text FROM @conversations@
UNION ALL
SELECT 'b' || CAST(item_id AS STRING) AS id, text FROM @benchmark@
"""

# Chinese and full-width punctuation around table values, for the literal functions
RELATIONS["f_marks"] = f"""
SELECT o_orderkey AS id,
  {pick(["，", "。", "！", "？", "；", "：", "（", "）", "【", "】", "《", "》", "、", "…", "—", "“", "”", "·", "～", "＃"], "o_orderkey")}
  || o_orderpriority || '中文' || CAST(o_orderkey AS STRING)
  || {pick(["，", "。", "！", "？", "〜", "﹏", "‘", "’", "＠", "＿"], "o_custkey")} || o_orderstatus AS text
FROM @orders@
"""

RELATIONS["f_pred"] = """
SELECT CAST(o_custkey % 8 AS INT) AS actual,
  CAST(CASE WHEN o_orderkey % 13 = 0 THEN (o_custkey + 1) % 8 ELSE o_custkey % 8 END AS INT) AS predicted,
  o_orderkey AS pos
FROM @orders@
"""

RELATIONS["f_votes"] = """
SELECT o_custkey AS column_id,
  CASE WHEN o_orderkey % 9 < 3 THEN 0 WHEN o_orderkey % 9 < 6 THEN 1 ELSE 2 END AS prediction,
  o_orderkey AS position
FROM @orders@
"""

RELATIONS["f_probs"] = """
SELECT CAST(o_custkey % 8 AS INT) AS class_id,
  CAST(50 + o_orderkey % 50 AS DOUBLE) / 100 AS p_true
FROM @orders@
"""

RELATIONS["f_runlog"] = """
SELECT 't' || CAST(user_id AS STRING) || '.log' AS file,
  CASE event_type WHEN 'error' THEN 'FAILED: Execution Error, return code ' || CAST(event_id % 7 AS STRING)
    ELSE 'OK' END AS line
FROM @events@
"""

RELATIONS["f_request_parts"] = """
SELECT CAST(event_id AS STRING) AS request_id, event_id, event_type, user_id,
  CASE event_id % 4 WHEN 0 THEN ''
    WHEN 1 THEN '"1' || substr(CAST(30000000000 + event_id * 7919 AS STRING), 2, 10) || '"'
    WHEN 2 THEN '"u' || CAST(user_id AS STRING) || '.' || event_type || '@example.com","n/a"'
    ELSE '"' || event_type || '","13' || substr(CAST(1000000000 + event_id AS STRING), 2, 9)
      || '","' || event_type || '"' END AS value_list
FROM @events@
"""

# a request lacks its comment, has a number for its port, or a null in its list now and then
RELATIONS["f_requests"] = """
SELECT request_id,
  CASE WHEN event_id % 97 = 5 THEN '[1,2]' WHEN event_id % 101 = 7 THEN '{"database_port": ' ELSE
  '{"database_port":' || CASE WHEN event_id % 11 = 3 THEN '3306' ELSE '"3306"' END
  || ',"database_name":"events_db","database_comment":"","database_type":"mysql","database_is_shard":"0"'
  || ',"table_name":"t_' || CAST(user_id AS STRING) || '","table_comment":"事件"'
  || CASE WHEN event_id % 9 = 0 THEN '' ELSE ',"table_theme":"流量"' END
  || ',"column_name":"' || CASE WHEN event_id % 5 = 0 THEN 'user_mobile' ELSE 'd:' || event_type END || '"'
  || ',"column_comment":"","column_type":"STRING","column_is_primary_key":"0","column_allow_null":"1"'
  || CASE WHEN event_id % 10 = 4 THEN ',"extra":1' ELSE '' END
  || ',"column_value":[' || value_list
  || CASE WHEN event_id % 13 = 6 AND event_id % 4 > 0 THEN ',null' ELSE '' END || ']}' END AS body
FROM @f_request_parts@
"""

RELATIONS["f_rules"] = """
SELECT 'd' || CAST(doc_id AS STRING) AS id, text FROM @documents@
UNION ALL
SELECT 'p' || CAST(page_id AS STRING) AS id, html AS text FROM @pages@
"""


DIGITS = "translate(md5(CAST(o_orderkey AS STRING)), 'abcdef', '012345')"


def md5_pick(values: list[str], at: int) -> str:
    """Entry of a list of up to 10, chosen by one digit of the md5 of the row key."""
    listing = "|".join(values)
    return f"split_part('{listing}', '|', CAST(substr(digits, {at}, 1) AS INT) % {len(values)} + 1)"


# columns whose class is their key modulo 8; comments name the class for a part only
RELATIONS["f_class_meta"] = f"""
SELECT
  'S_T' || CAST(c_custkey % 25 AS STRING) AS stage_table_name,
  'C' || CAST(c_custkey AS STRING) AS stage_column_name,
  {pick("3306 1521 1433 27017".split(), "c_custkey + c_nationkey")} AS database_port,
  lower(c_mktsegment) || '_db' AS database_name,
  '' AS database_comment,
  {pick("mysql oracle sqlserver mongodb hive".split(), "c_nationkey")} AS database_type,
  {pick(["1", "0"], "c_nationkey")} AS database_is_shard,
  't_' || lower(c_mktsegment) AS table_name,
  '客户表' AS table_comment,
  {pick("APP 支付 理财 风控".split(), "c_nationkey")} AS table_theme,
  CASE WHEN c_custkey % 3 = 0
    THEN {pick("card_no telephone addr cust_name mobile id_no email update_date".split(), "c_custkey")}
    ELSE 'f' || CAST(c_nationkey AS STRING) END AS column_name,
  CASE WHEN c_custkey % 5 = 0
    THEN {pick("银行卡号 固定电话 联系地址 客户姓名 手机号 身份证号 电子邮箱 更新时间".split(), "c_custkey")}
    ELSE '备注' END AS column_comment,
  {pick("varchar(64) string char(20)".split(), "c_nationkey")} AS column_type,
  '0' AS column_is_primary_key,
  {pick(["1", "0"], "c_nationkey")} AS column_allow_null,
  CASE WHEN c_custkey % 8 = 7 THEN '0' ELSE '1' END AS column_is_sensitive,
  CASE WHEN c_custkey % 8 = 7 THEN ''
    ELSE {pick("卡号 固定电话 地址 姓名 手机 身份证 邮箱 非敏感".split(), "c_custkey")} END
    AS column_sensitive_type
FROM @customer@
"""

RELATIONS["f_class_values"] = f"""
SELECT
  'S_T' || CAST(o_custkey % 25 AS STRING) AS stage_table_name,
  'C' || CAST(o_custkey AS STRING) AS stage_column_name,
  row_id,
  CASE o_custkey % 8
    WHEN 0 THEN '62' || substr(digits, 1, 14 + CAST(substr(digits, 32, 1) AS INT) % 4)
    WHEN 1 THEN '0' || substr(digits, 1, 2) || '-' || substr(digits, 3, 8)
    WHEN 2 THEN {md5_pick("广东省 江苏省 浙江省 山东省 河南省 四川省 湖北省".split(), 1)}
      || {md5_pick("东城市 南山市 西湖市 北安市 中原市".split(), 2)}
      || {md5_pick("人民路 解放路 中山路 建设路 和平街 新华街".split(), 3)} || substr(digits, 4, 3) || '号'
    WHEN 3 THEN {md5_pick("王 李 张 刘 陈 杨 赵 黄 周 吴".split(), 1)}
      || {md5_pick("伟 芳 娜 敏 静 丽 强 磊 军 洋".split(), 2)}
      || CASE WHEN substr(digits, 3, 1) < '5' THEN {md5_pick("勇 艳 杰 涛 明 超 霞 平 刚 英".split(), 4)} ELSE '' END
    WHEN 4 THEN '1' || {md5_pick("3 4 5 6 7 8 9".split(), 1)} || substr(digits, 2, 9)
    WHEN 5 THEN '11010' || substr(digits, 1, 1) || '19' || {md5_pick("5 6 7 8 9".split(), 2)} || substr(digits, 3, 1)
      || {md5_pick("01 02 03 04 05 06 07 08 09 10".split(), 4)} || {md5_pick("11 12 15 18 20 21 24 27 28 19".split(), 5)}
      || substr(digits, 6, 3) || {md5_pick("0 1 2 3 4 5 6 7 8 X".split(), 9)}
    WHEN 6 THEN {md5_pick("info sales li.wei zhang wang.fang admin chen li.na service liu".split(), 1)}
      || substr(digits, 2, 3) || '@' || {md5_pick("example.com example.org example.net mail.example.com".split(), 5)}
    ELSE CASE substr(digits, 1, 1) WHEN '0' THEN substr(digits, 2, 6) WHEN '1' THEN '2018-0' || substr(digits, 2, 1) || '-1' || substr(digits, 3, 1)
      WHEN '2' THEN 'OK' WHEN '3' THEN '0.' || substr(digits, 2, 4) WHEN '4' THEN 'NO' || substr(digits, 2, 7)
      ELSE substr(digits, 2, 11) END
  END AS column_value
FROM (SELECT o_custkey, o_orderkey AS row_id, {DIGITS} AS digits FROM @orders@) t
"""


def expand(sql: str, table) -> str:
    """Replace ``@name@`` by a relation in parentheses or by ``table(name)``."""

    def name(match: re.Match) -> str:
        word = match.group(1)
        return f"({expand(RELATIONS[word], table)})" if word in RELATIONS else table(word)

    return re.sub(r"@(\w+)@", name, sql)


def oracle_text(sql: str) -> str:
    """SQL for DuckDB, where the tables are views."""
    return expand(sql, lambda name: name)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a relation derived from it."""
    if name not in RELATIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(expand(RELATIONS[name], lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))
