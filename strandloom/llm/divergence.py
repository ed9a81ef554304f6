"""How the sources of a language differ in their words: a divergence audit by baseline corrections.

Terms are runs of bytes other than 0x00-0x40, 0x5B-0x60 and 0x7B-0x7F, with A-Z lower-cased and nothing else; null
text, language and source count as empty ones. A language keeps the ``V`` terms that ``least_docs`` of its documents
or more have. A (language, source) group, and each language as a whole, gives a kept term that it has ``count`` times
(0 included) the share p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being its occurrences of kept terms, and two
groups differ in a term by f, the distance of their shares. All of it is integer arithmetic.

Two groups' divergence, the sum of f over all V terms, comes from an inverted index without a look at the terms that
neither has. A group's share of a term that it lacks is one number z, so a pair starts at V |z_a - z_b|. Terms correct
this start:

* those of a alone, by |p_a - z_b| - |z_a - z_b|, which hangs on a term's count only: it comes from a's histogram of
  counts, met with the other groups of the language, and likewise for b;
* the postings of a term that both have, by |p_a - p_b| - |z_a - z_b| less what the two histograms gave for it. Only
  corrections other than zero are summed.

Words are counted a task at a time before they move once, by (language, term); so neither a frequent word nor a
frequent source gathers more rows anywhere than there are tasks and sources. Results: an empty table gives no row;
a group without terms has its pairs and no terms; a language without kept terms has pairs of value 0; a language
of one source has no pairs; repeated documents count as often as they come. Further columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: What a share of 1 comes to, and what each count is raised by (fixed values).
SCALE, PRIOR = 1_000_000_000, 5
LEAST_DOCS, TOP = 30, 50
#: Bytes that are in no term, and A-Z, as a table for ``bytes.translate``.
_FOLD = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Entries of a task's table of counts before it is sent on, and bytes of a text that are split at once.
HELD, PIECE = 1 << 19, 1 << 20


def terms_of(text: bytes):
    """The terms of a text, a piece of it at a time."""
    rest = b""
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE].translate(_FOLD)
        cut = piece.rfind(b" ") + 1 if at + PIECE < len(text) else len(piece)
        yield from piece[:cut].split()
        rest = piece[cut:]


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, as far as one task has counted them."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")]
    schema = "lang binary, source binary, term binary, n long, docs long"
    names = ["lang", "source", "term", "n", "docs"]
    types = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    C.small_batches(docs.sparkSession)

    def run(batches):
        from collections import Counter

        table: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        held = 0

        def sent():
            for (lang, source), (occurrences, documents) in table.items():
                terms = list(occurrences)
                for at in range(0, len(terms), 1 << 14):
                    some = terms[at : at + (1 << 14)]
                    cols = [[lang] * len(some), [source] * len(some), some, [occurrences[t] for t in some], [documents[t] for t in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=names)
            table.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                occurrences, documents = table.setdefault((lang, source), (Counter(), Counter()))
                before = len(occurrences)
                own = Counter(terms_of(text))
                occurrences.update(own)
                documents.update(own.keys())
                held += len(occurrences) - before
                if held > HELD:
                    yield from sent()
                    held = 0
        yield from sent()
        C.tidy()

    told = docs.select(*columns).mapInArrow(run, schema)
    return told.select(*[F.col(c).cast("string").alias(c) for c in names[:3]], "n", "docs")


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, exactly: products leave 64 bits, so decimals are divided."""
    whole = lambda c: c.cast("decimal(20,0)")
    top, bottom = F.lit(SCALE).cast("decimal(10,0)") * whole(count + PRIOR), whole(total + PRIOR * kept)
    return F.when(kept > 0, 1 + F.call_function("div", top, bottom).cast("long"))


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n) of the kept terms."""
    by_term = Window.partitionBy("lang", "term")
    dealt = count_terms(docs).repartition("lang", "term")  # the sums and the window below need no further exchange
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed.withColumn("docs", F.sum("docs").over(by_term)).where(F.col("docs") >= least_docs).select("lang", "source", "term", "n")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """Pairs (lang, source, item, value), item being the other source, both ways round; and terms (lang, source,
    item, value, rank), the ``top`` that a group has more of than its language."""
    index = C.written(postings(docs, least_docs), "postings", in_few=True)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*named).distinct()
    kept = index.groupBy("lang").agg(F.countDistinct("term").alias("V"), F.sum("n").alias("lang_total"))
    totals = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(kept, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["V", "total", "lang_total"])
    groups = C.written(groups.withColumn("z", F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("V")), F.lit(0))), "groups", in_few=True)
    shares = index.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("V")))

    # each posting of a group against the groups that may lack it, by counts and not by terms
    counts = shares.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("z_b"))
    alone = counts.join(other, "lang").where("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (F.abs(F.col("p") - F.col("z_b")) - F.abs(F.col("z") - F.col("z_b")))).alias("gain"))

    a = shares.select("lang", "term", "source", F.col("p").alias("p_a"), F.col("z").alias("z_a"))
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_b"), F.col("z").alias("z_b"))
    far = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = a.join(b, ["lang", "term"]).where("source < item")
    both = both.withColumn("fix", far("p_a", "p_b") + far("z_a", "z_b") - far("p_a", "z_b") - far("p_b", "z_a")).where("fix <> 0")
    both = both.groupBy("lang", "source", "item").agg(F.sum("fix").alias("gain"))

    start = groups.select("lang", "source", "V", "z").join(other, "lang").where("source < item")
    start = start.select("lang", "source", "item", (F.col("V") * far("z", "z_b")).alias("gain"))
    smaller = alone.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), "gain")
    value = start.unionByName(smaller).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("gain").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = value.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", "w.item", "value")

    whole = index.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    rise = shares.join(whole, ["lang", "term"]).withColumn("q", share(F.col("n_lang"), F.col("lang_total"), F.col("V"))).where("p > q")
    terms = rise.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs, ranked(terms).where(F.col("rank") <= top)


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, terms = audit(C.table(spark, sf_dir, "documents"))
    columns = ["lang", "source", F.col("part"), "item", "value", "rank"]
    return ranked(pairs).withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
