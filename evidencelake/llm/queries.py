"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, jaccard_join, license_scan, line_crf, line_dedup, mixing, periodic_runs, phrase_fingerprint, ppm, quality_model, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int):
    """crc32 of the id as text, modulo: the folds that the contracts name (null: of '')."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # the contract's digests take a conversation's whole text in one value, so it is one block
    read = chat_format.read_turns(chat_format.format_windows(turns, block_turns=None), whole_parts=True)
    return read.select(
        F.col("conv").alias("conv_id"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        F.col("n_windows").cast("long").alias("n_windows"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    model = quality_model.fit(docs, labels)
    return quality_model.predict(docs, model).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    out = line_crf.annotate(docs, line_crf.fit(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded")
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = ppm.fit(docs.where(fold(5) != 0))
    return ppm.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated(docs).select("doc_id", "text", F.col("lines_removed").cast("long").alias("lines_removed"))


#: Target weights by domain, language and source; branches that are not named weigh 1.
MIX_WEIGHTS = {("crawl",): 0.2, ("web",): 0.5, ("curated",): 0.3} | {
    (domain, lang): weight for domain in ("crawl", "web", "curated") for lang, weight in (("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1))
}
MIX_SHARE = 0.6
MIX_EPOCHS = 2


def mix_levels() -> dict:
    """Domain, language and source. The domain is told from the source's number."""
    number = F.expr("try_cast(substring(source, 4) as int)")
    domain = F.when(F.col("source") == "src0", "crawl").when(number < 12, "web").otherwise("curated")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mix_tokens():
    """Four characters a token, rounded up."""
    return F.ceil(F.char_length("text") / 4)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = mixing.mix(docs, mix_levels(), mix_tokens(), MIX_WEIGHTS, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=17)
    return out.select("doc_id", "lang", "source", F.coalesce(mix_tokens(), F.lit(0)).alias("tokens"), F.col("mix_epoch").alias("epoch"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs)
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["template"]), ",").alias("licenses"),
        F.coalesce(F.round(F.array_max(F.transform("licenses", lambda x: x["containment"])), 6), F.lit(0.0)).alias("containment"),
        F.array_min(F.transform("licenses", lambda x: x["word"])).alias("first_word"),
    )


def op10_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return phrase_fingerprint.compare_with_edits(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        moved = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(words[a + (i - a) % p]))
        return F.when(n > 0, F.array_join(moved, " "))

    # one-element array: the words are worked out once
    split = F.filter(F.split(F.col("text"), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    text = F.when(h % 10 == 0, F.transform(F.array(split), planted)[0]).otherwise(F.col("text"))
    found = periodic_runs.find(docs.select("doc_id", text.alias("text")))
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  the runs are in order of start and period
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(better(y, x), y).otherwise(x))
    best = F.when(F.size("runs") > 0, best)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_windows": op1_chat_windows,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_crf": op3_line_crf,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_ppm_language": op5_ppm_language,
    "op6_line_windows": op6_line_windows,
    "op7_mix": op7_mix,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_license_scan": op9_license_scan,
    "op10_phrase_fingerprint": op10_phrase_fingerprint,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op6_line_windows": r"""
        WITH split AS (
            SELECT doc_id, text, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
            FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)
        ), filled AS (
            SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM split
            WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
        ), wins AS (
            SELECT doc_id, pos AS a, lead(pos, 2) OVER w AS b, line AS l1, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3
            FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
        ), later AS (
            SELECT doc_id, a, b FROM (
                SELECT doc_id, a, b, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, a) AS nth FROM wins WHERE b IS NOT NULL
            ) WHERE nth > 1
        ), gone AS (
            SELECT DISTINCT s.doc_id, s.pos FROM split s JOIN later l ON s.doc_id = l.doc_id AND s.pos BETWEEN l.a AND l.b
        )
        SELECT d.doc_id,
               CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
               coalesce(g.n, 0) AS lines_removed
        FROM documents d
        LEFT JOIN (SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.pos) AS text
                   FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos WHERE g.pos IS NULL GROUP BY s.doc_id) k ON k.doc_id = d.doc_id
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
    """,
}


def _license_sql() -> str:
    values = ",\n            ".join(
        "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in item) + ")" for item in sorted(license_scan.TEMPLATES.items())
    )
    return rf"""
        WITH source AS (
            SELECT 'd' || doc_id AS key, doc_id, NULL AS template, text FROM documents
            UNION ALL SELECT 't' || name, NULL, name, text FROM (VALUES {values}) AS t(name, text)
        ), worded AS (
            SELECT key, doc_id, template, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM source
        ), shingles AS (
            SELECT key, doc_id, template, i - 1 AS place, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s
            FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) >= 5)
        ), known AS (
            SELECT template, s, count(*) OVER (PARTITION BY template) AS n FROM (SELECT DISTINCT template, s FROM shingles WHERE template IS NOT NULL)
        ), kinds AS (
            SELECT *, pow(2, ceil(log2(n)))::BIGINT AS reach FROM known
        ), hits AS (
            SELECT x.doc_id, x.place, x.s, k.template, k.n, k.reach, x.place // k.reach - o.back AS win
            FROM shingles x JOIN kinds k ON x.s = k.s, (VALUES (0), (1)) AS o(back) WHERE x.template IS NULL
        ), wins AS (
            SELECT doc_id, template, win, count(DISTINCT s) / any_value(n) AS containment, min(place) AS word
            FROM hits GROUP BY doc_id, template, win
        ), best AS (
            SELECT doc_id, template, containment, word FROM wins WHERE containment >= 0.8
            QUALIFY row_number() OVER (PARTITION BY doc_id, template ORDER BY containment DESC, word) = 1
        )
        SELECT d.doc_id, count(template) AS n_licenses, coalesce(string_agg(template, ',' ORDER BY template), '') AS licenses,
               coalesce(round(max(containment), 6), 0.0) AS containment, min(word) AS first_word
        FROM documents d LEFT JOIN best USING (doc_id) GROUP BY d.doc_id
    """


ORACLE_SQL["op9_license_scan"] = _license_sql()

ORACLE_SQL["op8_ngram_jaccard"] = r"""
    WITH RECURSIVE worded AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM worded WHERE len(w) > 0)
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
    ), links AS (
        SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 5 * c >= 4 * (x.n + y.n - c)
    ), reach AS (
        SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
    )
    SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id,
           (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
    FROM documents d
"""

ORACLE_SQL["op1_chat_windows"] = r"""
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)
    ), shaped AS (
        SELECT *, '<|turn|>' || replace(replace(role, '\', '\\'), '<|', '<\|') || '<|text|>' || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' AS f FROM said
    ), placed AS (
        SELECT *, (strlen(f) + 3) // 4 AS tokens, row_number() OVER w - 1 AS pos, coalesce(sum((strlen(f) + 3) // 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM shaped WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ), systems AS (
        SELECT conv_id, tokens AS system_tokens FROM placed WHERE pos = 0 AND role = 'system'
    ), roomed AS (
        SELECT p.*, 2048 - coalesce(s.system_tokens, 0) AS room, coalesce(s.system_tokens, 0) AS sys, s.system_tokens IS NOT NULL AND pos = 0 AS is_sys
        FROM placed p LEFT JOIN systems s ON s.conv_id IS NOT DISTINCT FROM p.conv_id
    ), halved AS (
        SELECT *, greatest(least(512, room // 2), 0) AS spare, greatest((room - greatest(least(512, room // 2), 0)) // 2, 1) AS half FROM roomed
    ), celled AS (
        SELECT *, CASE WHEN is_sys THEN NULL WHEN tokens > half THEN -1 - pos ELSE CAST((before - sys) // half AS BIGINT) END AS own FROM halved
    ), cells AS (
        SELECT *, coalesce(own, lead(own) OVER (PARTITION BY conv_id ORDER BY pos), 0) AS cell FROM celled
    ), spans AS (
        SELECT conv_id, min(pos) AS first, min(before) AS upto, any_value(sys) > 0 AS sys, least(any_value(spare), any_value(room) - coalesce(sum(tokens) FILTER (NOT is_sys), 0)) AS history
        FROM cells GROUP BY conv_id, cell
    ), repeated AS (
        SELECT s.conv_id, p.f FROM spans s JOIN placed p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND s.first > 0
        AND ((s.sys AND p.pos = 0) OR (NOT (s.sys AND p.pos = 0) AND p.pos >= s.first - 2 AND p.pos < s.first AND s.upto - p.before <= s.history))
    )
    SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
           (sum(length(f)) + coalesce(any_value(r.chars), 0))::BIGINT AS formatted_chars, any_value(n.windows) AS n_windows
    FROM placed p LEFT JOIN (SELECT conv_id, sum(length(f)) AS chars FROM repeated GROUP BY conv_id) r ON r.conv_id IS NOT DISTINCT FROM p.conv_id
    JOIN (SELECT conv_id, count(*) AS windows FROM spans GROUP BY conv_id) n ON n.conv_id IS NOT DISTINCT FROM p.conv_id
    GROUP BY p.conv_id
"""

ORACLE_SQL["op13_collocations"] = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
        FROM documents
    ), worded AS (
        SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
    ), grams AS (
        SELECT lang, m, w[i : i + m - 1] AS p
        FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (VALUES (1), (2), (3), (4)) AS s(m) WHERE len(w) >= m)
    ), counted AS MATERIALIZED (
        SELECT lang, m, array_to_string(p, ' ') AS phrase, any_value(p) AS p, count(*) AS f FROM grams GROUP BY lang, m, phrase
    ), totals AS (
        SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang
    ), candidates AS MATERIALIZED (
        SELECT lang, m, phrase, p, f AS a FROM counted WHERE m >= 2 AND f >= 30
    ), cuts AS MATERIALIZED (
        SELECT *, array_to_string(p[:k], ' ') AS head, array_to_string(p[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
    ), scored AS (
        SELECT c.*, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.a) // (h.f + t.f))::BIGINT AS score
        FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head JOIN counted t ON t.lang = c.lang AND t.phrase = c.rest
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
    ), inside AS (
        SELECT lang, a, unnest(CASE m WHEN 3 THEN [p[1:2], p[2:3]] WHEN 4 THEN [p[1:2], p[2:3], p[3:4], p[1:3], p[2:4]] END) AS p FROM candidates WHERE m > 2
    ), covers AS (
        SELECT lang, array_to_string(p, ' ') AS phrase, max(a) AS cover FROM inside GROUP BY lang, phrase
    ), ranked AS (
        SELECT s.* FROM scored s LEFT JOIN covers c ON c.lang = s.lang AND c.phrase = s.phrase WHERE c.cover IS NULL OR 100::HUGEINT * c.cover < 80::HUGEINT * s.a
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM ranked JOIN totals USING (lang)
    QUALIFY rank <= 2000
"""
