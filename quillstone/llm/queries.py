"""The queries of the training-data operators, one opN_<name> each, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import cut, documents, shared_dir, tokenizer_path


def op1_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.idfiles import read_ids, write_ids

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), path)
    return read_ids(spark, path, with_ids=False)


def op2_densified_oph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.oph import with_edits

    return with_edits(documents(spark, sf_dir))


def op3_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.shards import read_shards, write_shards

    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(documents(spark, sf_dir), path)
    crc = F.crc32(F.coalesce("row.text", F.lit("")).cast("binary"))
    return read_shards(spark, path).select("row.doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.resampling import resample

    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("row.doc_id", "log_weight", "kept")


def op5_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir), with_text=True).drop("kept")


def op6_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.bpe import encode_decode

    return encode_decode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op7_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.ngram_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op8_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.unigram_count import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), split=False)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir)).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.mixture import mix

    return mix(documents(spark, sf_dir)).drop("copies")


def op11_cascading_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.erasure import erase_masters, read_back

    folder = f"{shared_dir(spark)}/erasure-{uuid.uuid4().hex}"
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clients", "clicks", "sales", "sale_lines")]
    files = read_back(erase_masters(spark, *tables, folder), {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"})
    return files.select("file_no", "n_rows", "n_erased", "cents", "rewritten", "table_name", "ids_sha256", "columns", "path")


def op12_pivot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.collocations import collocations

    return collocations(documents(spark, sf_dir))


def op13_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.chat import read_windows, windows

    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_windows(cut(windows(turns, tokenizer_path("byte_bpe_50k.json")), "windows"))


QUERIES = {f.__name__: f for f in (op1_plane_files, op2_densified_oph, op3_two_pass_shuffle, op4_importance_resampling, op5_run_length_repeats, op6_speculative_bpe, op7_grouped_prefix_join, op8_viterbi_counts, op9_exact_dedup, op10_subset_sum_mix, op11_cascading_erasure, op12_pivot_phrases, op13_budgeted_windows)}

ORACLES = {
    "op12_pivot_phrases": r"""
        WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
        ws AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
        grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' '))) AS gram FROM ws, range(1, 5) AS ks(k)),
        counted AS (SELECT lang, k, gram, count(*) AS f FROM grams GROUP BY ALL),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
        frequent AS (SELECT *, string_split(gram, ' ') AS w FROM counted WHERE f >= 30),
        cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM frequent WHERE k > 1),
        halves AS (SELECT *, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail FROM cuts),
        scored AS (SELECT h.lang, h.gram, h.k, h.w, h.f AS a, cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * h.f) // (l.f + r.f))::BIGINT AS score
                   FROM halves h JOIN frequent l ON l.lang = h.lang AND l.gram = h.head JOIN frequent r ON r.lang = h.lang AND r.gram = h.tail),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
        spans AS (SELECT lang, k, f, w, unnest(range(2, k)) AS s FROM frequent WHERE k > 2),
        inner_spans AS (SELECT lang, f, s, w, unnest(range(1, k - s + 2)) AS i FROM spans),
        around AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS gram, max(f) AS longer FROM inner_spans GROUP BY ALL),
        kept AS (SELECT b.* FROM best b LEFT JOIN around o USING (lang, gram) WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
