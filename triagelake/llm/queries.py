"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .common import shared_dir, table
from .line_dedup import remove_lines
from .neighbours import nearest
from .ngram_join import near_duplicates
from .packing import pack_documents
from .periodic_runs import find_runs, run_digest, with_planted_runs
from .secrets import find_secrets, secret_digest
from .sentencepiece_fst import encode_and_decode
from .substring_dedup import remove_repeats
from .token_records import with_starts, write_index, write_records
from .url_filter import Rule, judge
from .vector_codes import compress
from .winnowing import compare_edited

WORD_VOCABULARY, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return compare_edited(table(spark, sf_dir, "documents"), k=3, window=4)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP4_SQL = """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all documents, decoded again."""
    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated and nearly repeated lines leaves of all documents."""
    return remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True, exact_short=True, scaled=True)


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files of all documents, written and read back."""
    out = shared_dir(spark, "records")
    write_records(table(spark, sf_dir, "documents"), f"{out}/data", public_tokenizers.path(WORD_VOCABULARY))
    index = write_index(spark, f"{out}/data", f"{out}/index")
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32")


URL_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated windows of 13 words leaves of all documents."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, the network trained on those not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings, from codebooks of 4 rounds."""
    return compress(table(spark, sf_dir, "embeddings"))


def op11_sql(rounds: int = 4) -> str:
    """The rounds written out: each assigns every part by exact distances, then replaces entries by floored means."""
    steps = [
        """with kept as materialized (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), cut as materialized (
  select r, vec_id, p.p, list_slice(v, (p.p * len(v) // 4 + 1)::int, ((p.p + 1) * len(v) // 4)::int) as x from kept, range(4) p(p)
), book0 as materialized (
  select p, e, x as c from (select p, x, row_number() over (partition by p order by vec_id) - 1 as e from cut where vec_id is not null) where e < 256
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""near{i} as materialized (
  select r, p, x, arg_min(e, (d, e)) as e, min(d) as d from (
    select r, cut.p, x, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) as d from cut join book{i} b on b.p = cut.p
  ) group by r, p, x
)""")
        if i < rounds:
            steps.append(f"""book{i + 1} as materialized (
  select b.p, b.e, coalesce(m.c, b.c) as c from book{i} b left join (
    select p, e, list(floor(s / n) order by k) as c from (
      select p, e, k, sum(x[k]) as s, count(*) as n from near{i}, range(1, 4097) t(k) where k <= len(x) group by p, e, k
    ) group by p, e
  ) m on m.p = b.p and m.e = b.e
)""")
    last = rounds
    steps.append(f"""coded as (
  select r, string_agg(printf('%02x', e::int), '' order by p) as code, sum(d)::bigint as error from near{last} group by r
), joined as (
  select k.vec_id, k.label, code, error from coded join kept k using (r)
), told as (
  select sha256(string_agg(list_aggregate(list_transform(c, lambda x: x::bigint), 'string_agg', ','), ',' order by p, e)) as codebooks_sha256 from book{last}
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from joined, told""")
    return ", ".join(steps[:-1]) + ", " + steps[-1]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, periodic ends planted in a tenth of them, and what collapsing them leaves."""
    docs = table(spark, sf_dir, "documents")
    return run_digest(find_runs(docs.select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    return {"op1_ngram_join": op1_ngram_join, "op2_packing": op2_packing, "op3_fingerprints": op3_fingerprints, "op4_neighbours": op4_neighbours, "op5_sentencepiece": op5_sentencepiece, "op6_line_dedup": op6_line_dedup, "op7_token_records": op7_token_records, "op8_url_filter": op8_url_filter, "op9_substring_dedup": op9_substring_dedup, "op10_language": op10_language, "op11_vector_codes": op11_vector_codes, "op12_periodic_runs": op12_periodic_runs, "op13_secrets": op13_secrets}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op4_neighbours": OP4_SQL, "op11_vector_codes": op11_sql()}
