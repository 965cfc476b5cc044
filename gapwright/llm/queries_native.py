"""Queries of the operators that use DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, privacy


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontamination.contaminated(docs, benchmark)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = privacy.personal_spans(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in privacy.KINDS]
    digest = F.sha2(privacy.listed(*privacy.KINDS), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, privacy.listed(*privacy.KINDS, "term").alias("spans"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations, each with its neighbour's answer as the rejected one, by turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.preference_segments(*chat.swapped_answers(turns)).withColumnRenamed("id", "conv_id")


OP6_SQL = """
with said as (
  select conv_id, turn, min({'role': coalesce(role, ''), 'text': replace(coalesce(text, ''), '<|im_', '<| im_')}) as s
  from conversations where conv_id is not null and turn is not null group by 1, 2
), ended as (select conv_id, max(turn) as last, arg_max(s.text, turn) as answer from said where s.role = 'assistant' group by 1
), sides as (
  select t.conv_id, t.turn, t.s.role as role, t.s.text as chosen,
    case when t.turn = e.last then coalesce(o.answer, '') else t.s.text end as rejected
  from said t left join ended e using (conv_id) left join ended o on o.conv_id = xor(e.conv_id, 1)
  where e.last is null or t.turn <= e.last
), cut as (select conv_id, min(turn) as split from sides where chosen <> rejected group by 1
), parts as (
  select conv_id, turn, role, 'prompt' as part, chosen as text from sides left join cut using (conv_id) where split is null or turn < split
  union all select conv_id, turn, role, 'chosen', chosen from sides join cut using (conv_id) where turn >= split
  union all select conv_id, turn, role, 'rejected', rejected from sides join cut using (conv_id) where turn >= split
)
select conv_id, part, turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as segment,
  case when part <> 'prompt' and role = 'assistant' then 13 + length(role) else 0 end::bigint as loss_start,
  case when part <> 'prompt' and role = 'assistant' then 23 + length(role) + length(text) else 0 end::bigint as loss_end
from parts
"""
