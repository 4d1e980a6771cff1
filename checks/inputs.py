"""Inputs of the registered queries: the given tables, and texts with more
personal data derived from them by the same expression in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspan.functions.dealing import deal_out


def table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return deal_out(df, *keys) if keys else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return deal_out(docs, "doc_id")


# Both engines read these expressions; they add one value of every pattern.
RICH_TEXT = """concat(text,
  ' Reach Mary Baker or Karl Wagner at mary.', cast(doc_id % 50 as {string}),
  '@corp.io, @dev_', cast(doc_id % 7 as {string}),
  ' or +1 415-555-', lpad(cast(doc_id % 10000 as {string}), 4, '0'),
  '. SSN ', cast(100 + doc_id % 900 as {string}),
  '-12-3456, card 4000-1234-5678-', lpad(cast(doc_id % 97 as {string}), 4, '0'),
  ', host 10.0.', cast(doc_id % 256 as {string}),
  '.7, see https://wiki.corp.io/p', cast(doc_id % 40 as {string}),
  ' now; again mary.', cast(doc_id % 50 as {string}), '@corp.io')"""

SESSION_TEXT = """concat(text,
  ' I am Mary Baker, mail Mary.', cast(conv_id % 30 as {string}),
  '@corp.io or mary.', cast((conv_id + turn) % 30 as {string}),
  '@corp.io, call 415-555-', lpad(cast((conv_id * 7 + turn) % 10000 as {string}), 4, '0'),
  ' today')"""

ACCOUNT_TEXT = """concat(text, ' paid by CUSTOMER#',
  lpad(cast((doc_id * 3) % 2000 as {string}), 9, '0'),
  ' and customer#', lpad(cast((doc_id * 7) % 2000 as {string}), 9, '0'),
  ', ref customer#', lpad(cast((doc_id * 3) % 2000 as {string}), 9, '0'), '7')"""

ENTITY_TEXT = """concat('Talk to Anna Maria Lopez', cast(doc_id % 9 as {string}),
  ' - sales about Project Falcon', cast(doc_id % 5 as {string}),
  ' Inc and Client Meetings', cast(doc_id % 5 as {string}),
  ' in Berlin. Team, 10.1.2.', cast(doc_id % 200 as {string}),
  ' and Acme', cast(doc_id % 11 as {string}), chr(10), 'Ltd on 4 May, mail a',
  cast(doc_id % 13 as {string}), '@corp.io. ', text)"""


def derived(df: DataFrame, expression: str) -> DataFrame:
    return df.withColumn("text", F.expr(expression.format(string="string")))


def sql_text(expression: str) -> str:
    return expression.format(string="varchar")


def rich_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(documents(spark, sf_dir), RICH_TEXT)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn")
    return derived(turns, SESSION_TEXT)
