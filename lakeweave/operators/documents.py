"""Per-document operators: cleaning, paragraphs, lines, selection, ranking, relations.

All of them keep a document's parts in one row as arrays until a join on terms needs rows,
so cleaning and measuring a corpus takes no shuffle at all.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeweave.functions import fixed, text as X
from lakeweave.functions.arrow import map_arrow
from lakeweave.operators import segments
from lakeweave.sources.tables import materialize, spread


def filled(df: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return spread(df.select("doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


#: Fenced code, or a table's delimiter row: texts with either are cleaned line by line, so that these stay as they are.
PROTECTED = r"(?m)^[ \t]*(?:`{3,}|~{3,})|^[ \t]*\|?(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*(?::?-+:?)?[ \t]*\|?[ \t]*$"
_ANY_BOILERPLATE = r"(?im)^[ \t\r]*(?:sent from my |page\s+\d|on .+ wrote:|-{4}|={4}|_{4}|\*{4}|~{4})"


def clean(df: DataFrame) -> DataFrame:
    """Stages of safe cleaning as columns: text, normalized, plain (without boilerplate), unique (without repeated paragraphs), n_paragraphs, n_unique.

    Fenced code and tables keep their lines. Texts with neither, nearly all, never leave the JVM.
    """
    t = filled(df)
    held = F.col("text").rlike(PROTECTED)
    return _clean_plain(t.filter(~held)).unionByName(_clean_protected(t.filter(held)))


def _clean_plain(t: DataFrame) -> DataFrame:
    t = t.withColumn("normalized", X.normalized(F.col("text")))
    kept = F.filter(X.lines(F.col("normalized")), lambda x: X.boilerplate_kind(x).isNull())
    t = t.withColumn("plain", F.when(F.col("normalized").rlike(_ANY_BOILERPLATE), F.array_join(kept, "\n")).otherwise(F.col("normalized")))
    t = t.withColumn("parts", X.paragraphs(F.col("plain"))).withColumn("keys", F.transform("parts", X.paragraph_key)).withColumn("n_unique", F.size(F.array_distinct("keys")))
    # only where keys repeat is a paragraph's first place looked for
    first = F.filter("parts", lambda p, i: F.array_position(F.col("keys"), F.get(F.col("keys"), i)) == i + 1)
    unique = F.array_join(F.when(F.col("n_unique") == F.size("parts"), F.col("parts")).otherwise(first), "\n\n")
    return t.select("doc_id", "text", "normalized", "plain", unique.alias("unique"), F.size("parts").alias("n_paragraphs"), "n_unique")


def _clean_protected(t: DataFrame) -> DataFrame:
    kinds = [re.compile(p) for _, p in fixed.BOILERPLATE]
    id_type = dict(t.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            normalized, _ = segments.normalize(text)
            lines = normalized.split("\n")
            safe = segments.protected(lines)
            plain = "\n".join(x for x, keep in zip(lines, safe) if keep or not any(k.match(x.strip(" \t\r")) for k in kinds))
            parts = segments.paragraphs(plain)
            # a fence is a paragraph like any other, but with its inner blanks
            first = {p if segments.FENCE.match(p) else " ".join(p.split()): p for p in reversed(parts)}
            kept = set(map(id, first.values()))
            rows.append((text, normalized, plain, "\n\n".join(p for p in parts if id(p) in kept), len(parts), len(first)))
        cols = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.string()) for c in cols[:4]), *(pa.array(c, pa.int32()) for c in cols[4:])], names=["doc_id", "text", "normalized", "plain", "unique", "n_paragraphs", "n_unique"])

    return map_arrow(t, run, f"doc_id {id_type}, text string, normalized string, plain string, unique string, n_paragraphs int, n_unique int")


def savings(df: DataFrame) -> DataFrame:
    """(doc_id, tokens_before, tokens_after, saved, saved_percent, n_paragraphs, n_removed, digest of the cleaned text) of the cleaning."""
    t = clean(df).select("doc_id", X.token_estimate(F.col("text")).alias("tokens_before"), X.token_estimate(F.col("unique")).alias("tokens_after"), "n_paragraphs", (F.col("n_paragraphs") - F.col("n_unique")).alias("n_removed"), F.sha2("unique", 256).alias("digest"))
    saved = F.col("tokens_before") - F.col("tokens_after")
    return t.withColumn("saved", saved).withColumn("saved_percent", F.when(F.col("tokens_before") > 0, F.round(saved * 100 / F.col("tokens_before"), 2)).otherwise(F.lit(0.0)))


def stage_contributions(df: DataFrame) -> DataFrame:
    """(stage, n_docs, tokens_in, tokens_out, tokens_saved): what each cleaning stage gives over all documents."""
    t = clean(df).select(*[X.token_estimate(F.col(c)).alias(c) for c in ("text", "normalized", "plain", "unique")])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(a).alias("i"), F.col(b).alias("o")) for s, a, b in (("normalize", "text", "normalized"), ("boilerplate", "normalized", "plain"), ("deduplicate", "plain", "unique"))]))
    return t.select(rows.alias("s")).groupBy("s.stage").agg(F.count("*").alias("n_docs"), F.sum("s.i").alias("tokens_in"), F.sum("s.o").alias("tokens_out"), F.sum(F.col("s.i") - F.col("s.o")).alias("tokens_saved"))


def recommendation(df: DataFrame) -> DataFrame:
    """(doc_id, action, reason): whether cleaning a document is worth it, by tokens and repeated paragraphs."""
    s = savings(df)
    ratio = F.when(F.col("n_paragraphs") > 0, F.round(F.col("n_removed") / F.col("n_paragraphs"), 4)).otherwise(F.lit(0.0))
    s = s.withColumn("duplicate_ratio", ratio)
    low = (F.col("saved_percent") < 5) | (F.col("saved") < 20)
    many = (F.col("duplicate_ratio") >= 0.2) & (F.col("n_removed") >= 1)
    high = (F.col("saved_percent") >= 15) | (F.col("saved") >= 50)
    what = (
        F.when(F.col("tokens_after") >= 100000, F.struct(F.lit("manual_review").alias("a"), F.lit("large_after_cleaning").alias("r")))
        .when(F.col("tokens_before") < 80, F.struct(F.lit("skip").alias("a"), F.lit("small_input").alias("r")))
        .when(low, F.struct(F.lit("skip").alias("a"), F.lit("low_projected_savings").alias("r")))
        .when(many, F.struct(F.lit("optimize_safe").alias("a"), F.lit("high_duplication").alias("r")))
        .when(high, F.struct(F.lit("optimize_safe").alias("a"), F.lit("high_projected_savings").alias("r")))
        .otherwise(F.struct(F.lit("skip").alias("a"), F.lit("low_projected_savings").alias("r")))
    )
    return s.select("doc_id", what["a"].alias("action"), what["r"].alias("reason"), "duplicate_ratio", "saved", "saved_percent")


def boilerplate_counts(df: DataFrame) -> DataFrame:
    """(kind, n_lines, n_docs) of whole-line boilerplate."""
    t = filled(df).select("doc_id", F.filter(F.transform(X.lines(F.col("text")), X.boilerplate_kind), lambda k: k.isNotNull()).alias("kinds"))
    return t.select("doc_id", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


def structure(df: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_lines, n_filled_lines, longest_line, n_paragraphs, longest_paragraph, blank_runs)."""
    t = filled(df).withColumn("ls", X.lines(F.col("text"))).withColumn("ps", X.paragraphs(F.col("text")))
    longest = lambda c: F.coalesce(F.array_max(F.transform(c, lambda x: F.length(x))), F.lit(0))
    return t.select(
        "doc_id", F.length("text").alias("n_chars"), F.size("ls").alias("n_lines"), F.size(F.filter("ls", lambda x: ~x.rlike(r"^[ \t\r]*$"))).alias("n_filled_lines"),
        longest("ls").alias("longest_line"), F.size("ps").alias("n_paragraphs"), longest("ps").alias("longest_paragraph"), X.count_matches(F.col("text"), r"\n(?:[ \t]*\n)+").alias("blank_runs"),
    )


def line_table(df: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, char_start): lines with their offsets."""
    rows = filled(df).select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("line_no", "line"))
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("char_start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))


def chunk_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(first line, last line, first character, text) of the unbroken runs of lines that are not blank."""
    out, at, begin = [], 0, None
    lines = text.split("\n")
    for i, line in enumerate([*lines, ""]):
        blank = not line.strip(" \t\n\x0b\f\r")
        if blank and begin is not None:
            first, start = begin
            out.append((first, i - 1, start, text[start : at - 1]))
            begin = None
        elif not blank and begin is None:
            begin = (i, at)
        at += len(line) + 1
    return out


def chunks(df: DataFrame) -> DataFrame:
    """(doc_id, idx, chunk_id, label, char_start, char_end, line_start, line_end, duplicate_of, tokens, text).

    A chunk is an unbroken run of lines that are not blank; duplicate_of is the first chunk of
    the document with the same stripped text. One pass, no shuffle.
    """
    id_type = dict(df.dtypes)["doc_id"]
    heading = re.compile(r"#{1,6}[ \t]+\S")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, t in enumerate(batch.column("text").to_pylist()):
            seen: dict[str, str] = {}
            for idx, (l0, l1, start, body) in enumerate(chunk_spans(t)):
                end = start + len(body)
                name = f"chunk_{idx + 1:04d}_" + hashlib.sha256(f"{idx}\0{start}\0{end}\0{body}".encode()).hexdigest()[:12]
                key = body.strip(" \t\n\x0b\f\r")
                first = seen.setdefault(key, name)
                rows.append((i, idx, name, "heading" if l0 == l1 and heading.match(key) else "paragraph_block", start, end, l0 + 1, l1 + 1, None if first == name else first, body))
        cols = list(zip(*rows)) or [()] * 10
        ints = {1, 4, 5, 6, 7}
        arrays = [pa.array(c, pa.int64() if k in ints else pa.string()) for k, c in enumerate(cols[1:], 1)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0], pa.int64())), *arrays], names=["doc_id", "idx", "chunk_id", "label", "char_start", "char_end", "line_start", "line_end", "duplicate_of", "text"])

    c = map_arrow(filled(df), run, f"doc_id {id_type}, idx long, chunk_id string, label string, char_start long, char_end long, line_start long, line_end long, duplicate_of string, text string")
    whole = ("idx", "line_start", "line_end")
    return c.select("doc_id", *[F.col(x).cast("int").alias(x) if x in whole else F.col(x) for x in c.columns[1:9]], X.token_estimate(F.col("text")).alias("tokens"), "text")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """(doc_id, digest, first_doc_id, n_copies) of texts that stand in several documents; only hashes are shuffled."""
    t = filled(df).filter("text <> ''").select("doc_id", F.sha2("text", 256).alias("digest"))
    groups = t.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    return t.join(groups, "digest")


def document_frequency(df: DataFrame, least_df: int = 1) -> DataFrame:
    """(term, n_docs) over the corpus."""
    t = filled(df).select(F.explode(X.terms(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least_df)


def _query(question: str) -> Column:
    return X.terms(F.lit(question))


def mechanical_score(df: DataFrame, question: str) -> DataFrame:
    """(doc_id, overlap, score, decision): share of the question's terms (6 at most) a document holds."""
    q = _query(question)
    overlap = F.size(F.array_intersect(X.terms(F.col("text")), q))
    score = F.when(F.size(q) == 0, F.lit(1.0)).otherwise(F.bround(F.least(F.lit(1.0), overlap / F.greatest(F.lit(1), F.least(F.lit(6), F.size(q)))), 2))
    t = filled(df).select("doc_id", overlap.alias("overlap"), score.alias("score"), F.length("text").alias("n"))
    return t.select("doc_id", "overlap", "score", F.when(F.col("n") < 80, "short_block").when(F.col("score") > 0, "lexical_overlap").otherwise("no_lexical_overlap").alias("decision"))


def bm25(df: DataFrame, question: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, score, rank) of documents with a term of the question, by BM25 over the corpus.

    Terms that the question lacks never leave the scan: what is shuffled is bounded by the
    documents that match.
    """
    q = _query(question)
    t = filled(df).select("doc_id", X.words(F.col("text")).alias("ws"))
    t = t.select("doc_id", F.size("ws").alias("len"), F.filter("ws", lambda w: F.array_contains(q, w)).alias("hits"))
    n, avg_len = t.agg(F.count("*")).scalar(), t.agg(F.avg("len")).scalar()
    tf = t.select("doc_id", "len", F.explode("hits").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("f"))
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    s = tf.join(F.broadcast(df_), "term").withColumn("n", n).withColumn("avg_len", avg_len)  # df_ has a row per term of the question
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return s.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def select_chunks(df: DataFrame, question: str) -> DataFrame:
    """(doc_id, idx, reasons, skipped): chunks that meet the question, with why.

    keyword_overlap: a term in common; rare_term_match: a term that one or two of the
    document's chunks hold; heading_match for headings; matched_heading_proximity: within
    three chunks under a matched heading. Repeated chunks are kept out, and told.
    """
    q = _query(question)
    c = chunks(df).select("doc_id", "idx", "label", F.col("duplicate_of").isNotNull().alias("repeated"), F.array_intersect(X.terms(F.col("text")), q).alias("hits"))
    per = c.filter(~F.col("repeated")).select("doc_id", F.explode("hits").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    rare = per.filter("n <= 2").groupBy("doc_id").agg(F.collect_set("term").alias("rare"))
    c = c.join(rare, "doc_id", "left")
    w = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    head = F.last(F.when(F.col("label") == "heading", F.struct("idx", (F.size("hits") > 0).alias("hit"))), True).over(w)
    c = c.withColumn("head", head)
    is_head = F.col("label") == "heading"
    met = F.size("hits") > 0
    why = F.array(
        F.when(is_head & met, F.lit("heading_match")),
        F.when(~is_head & met, F.lit("keyword_overlap")),
        F.when(~is_head & F.arrays_overlap("hits", F.coalesce("rare", F.array().cast("array<string>"))), F.lit("rare_term_match")),
        F.when(~is_head & F.col("head.hit") & (F.col("idx") - F.col("head.idx") <= 3), F.lit("matched_heading_proximity")),
    )
    c = c.withColumn("why", F.filter(why, lambda x: x.isNotNull())).filter(F.size("why") > 0)
    return c.select("doc_id", "idx", F.array_join("why", ",").alias("reasons"), F.col("repeated").alias("skipped"))


def relations(df: DataFrame, question: str = "", least_shared: int = 2) -> DataFrame:
    """(doc_id, src, dst, type, confidence) between a document's chunks.

    DUPLICATES: equal text, to the first. SUPPORTS: two distinctive terms in common or more,
    from the later to the earlier; a term is distinctive if the question lacks it and more
    than one, but at most max(2, n / 2) and 64, of the chunks hold it. One further edge by the
    first class of cue a chunk has, to the earliest other chunk in common: SUPERSEDES (one
    term), QUALIFIES, CONTRADICTS (two). Terms that a cap excludes make no edge at all, by
    definition of distinctive; it also bounds the join.
    """
    return edges(chunks(df).select("doc_id", "idx", F.col("chunk_id").alias("part_id"), "duplicate_of", "text"), question, least_shared)


def edges(parts: DataFrame, question: str = "", least_shared: int = 2) -> DataFrame:
    """The relations between parts (doc_id, idx, part_id, duplicate_of, text), as of :func:`relations`."""
    # what the edges need of a part is read by every kind of edge: written once, without texts
    text = F.col("text")
    cues = F.when(text.rlike(fixed.SUPERSESSION), 1).when(text.rlike(fixed.QUALIFIER), 2).when(text.rlike(fixed.NEGATION), 3)
    c = materialize(parts.select("doc_id", "idx", "part_id", "duplicate_of", cues.alias("cued"), (F.length("text") >= 80).alias("long"), F.array_except(X.terms(text, 4), _query(question)).alias("terms")), "parts")
    # only documents with several chunks can have relations
    c = c.withColumn("n", F.count("*").over(W.partitionBy("doc_id"))).filter("n > 1")
    dup = c.filter(F.col("duplicate_of").isNotNull()).alias("a").join(c.select("doc_id", F.col("part_id").alias("duplicate_of"), F.col("idx").alias("dst")), ["doc_id", "duplicate_of"]).select("doc_id", F.col("idx").alias("src"), "dst", F.lit("DUPLICATES").alias("type"), F.lit(1.0).alias("confidence"))
    post = c.select("doc_id", "idx", "n", F.explode("terms").alias("term"))
    post = post.withColumn("df", F.count("*").over(W.partitionBy("doc_id", "term"))).filter((F.col("df") > 1) & (F.col("df") <= F.least(F.lit(64), F.greatest(F.lit(2), F.floor(F.col("n") / 2)))))
    a, b = post.select("doc_id", "term", F.col("idx").alias("i")), post.select("doc_id", "term", F.col("idx").alias("j"))
    shared = a.join(b, ["doc_id", "term"]).filter("i < j").groupBy("doc_id", "i", "j").agg(F.count("*").alias("shared"))
    supports = shared.filter("shared >= 2").select("doc_id", F.col("j").alias("src"), F.col("i").alias("dst"), F.lit("SUPPORTS").alias("type"), F.lit(0.6).alias("confidence"))
    both = both_ways(shared, "i", "j", "shared")
    least = F.when(F.col("cued") == 1, 1).when(F.col("cued") == 3, least_shared).when(F.col("long"), 2)
    cued = c.filter("cued is not null").select("doc_id", "idx", "cued", least.alias("least")).join(both, ["doc_id", "idx"]).filter(F.col("shared") >= F.col("least"))
    first = cued.groupBy("doc_id", F.col("idx").alias("src"), "cued").agg(F.min("other").alias("dst"))
    kinds = (("SUPERSEDES", 0.75), ("QUALIFIES", 0.7), ("CONTRADICTS", 0.6))
    pick = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in kinds]), F.col("cued"))
    first = first.select("doc_id", "src", "dst", pick(0).alias("type"), pick(1).alias("confidence"))
    return dup.unionByName(supports).unionByName(first)


def both_ways(pairs: DataFrame, a: str, b: str, *rest: str) -> DataFrame:
    """(doc_id, idx, other, rest) of every pair from either side, in one pass."""
    side = lambda x, y: F.struct(F.col(x).alias("idx"), F.col(y).alias("other"))
    return pairs.select("doc_id", F.explode(F.array(side(a, b), side(b, a))).alias("p"), *rest).select("doc_id", "p.idx", "p.other", *rest)


def closure(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, idx, type, confidence): what one hop from the kept chunks (doc_id, idx) pulls in, by its strongest edge."""
    both = both_ways(edges, "src", "dst", "type", "confidence")
    near = both.join(kept.select("doc_id", F.col("idx").alias("other")), ["doc_id", "other"], "left_semi").join(kept, ["doc_id", "idx"], "left_anti")
    rank = F.row_number().over(W.partitionBy("doc_id", "idx").orderBy(F.desc("confidence"), "type", "other"))
    return near.withColumn("r", rank).filter("r = 1").select("doc_id", "idx", "type", "confidence")
