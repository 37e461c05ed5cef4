"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves, in SQL functions alone.

A text splits at blank lines into sections, a section at line breaks into
paragraphs, both at literal strings, and a paragraph into leaves of four words with
the white space after them (words of 16 characters at most: longer runs, as in
scripts without spaces, are cut), so the text can be put together again and
different texts have different trees. A leaf's digest is MD5 of its text; a
paragraph's is SHA-256 of its leaves' digests, a section's of its paragraphs'
digests, the root of the sections' digests. Roots test equality. Where roots
differ, sections that occur on both sides are skipped and the paragraphs of the
others are compared, which locates an edit.

Likeness is read off the trees as well: the Dice coefficient of their sets of leaf
digests; two empty texts are alike.

Defined results: a null text is the empty text, whose tree is one empty section
with one empty paragraph and no leaf; texts of any length are taken whole; documents with
equal ids are ordered by text; an empty table gives an empty table; further
columns are ignored. A null doc_id stands after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_text

#: A leaf of a paragraph; the same in Java's and RE2's dialects. Every character is in one.
LEAF = "[ \\t\\x0B\\f\\r]*(?:[^ \\t\\x0B\\f\\r]{1,16}[ \\t\\x0B\\f\\r]*){1,4}|[ \\t\\x0B\\f\\r]+"
#: A window of neighbouring ids is one partition's work; ids are distinct numbers, so it has this many rows at most.
ID_BITS = 10
#: Windows (a row of 30 bytes each) up to which their top rows' ids are broadcast.
BROADCAST_WINDOWS = 200_000


def tree(text: Column) -> Column:
    """array<array<array<string>>>: the leaves' digests by section and paragraph; all above them follows."""
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), F.md5)))


def paragraphs(sections: Column) -> Column:
    """array<array<string>>: the paragraphs' digests by section."""
    return F.transform(sections, lambda s: F.transform(s, lambda p: F.sha2(F.array_join(p, ""), 256)))


def branches(digests: Column) -> Column:
    """array<string>: each section's digest, made of its paragraphs' digests."""
    return F.transform(digests, lambda s: F.sha2(F.array_join(s, ""), 256))


def root(branches_: Column) -> Column:
    return F.sha2(F.array_join(branches_, ""), 256)


def leaves(sections: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(sections)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of leaf digests."""
    sizes = F.size(a) + F.size(b)
    return F.when(sizes == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / sizes)


def differing(a: Column, b: Column) -> Column:
    """Paragraph digests of one tree that stand in sections the other hasn't and in no such section of it: where an
    edit is. a, b: digests by section; sections are compared as wholes, by hash."""

    def only(x: Column, y: Column) -> Column:
        whole = lambda t: F.transform(t, lambda s: F.array_join(s, ","))
        return F.flatten(F.transform(F.array_except(whole(x), whole(y)), lambda s: F.split(s, ",")))

    return F.array_except(only(a, b), only(b, a))


def first_difference(a: Column, b: Column) -> Column:
    """The least index at which two arrays differ (one may be longer); null for equal ones."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.get(F.filter(F.sequence(F.lit(0), longest), lambda i: (i < longest) & ~F.get(a, i).eqNullSafe(F.get(b, i))), F.lit(0))


def trees(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, sections: the operator's own output, no shuffle."""
    d = id_text(docs).select("doc_id", tree(F.col("text")).alias("sections"))
    return d.select("doc_id", root(branches(paragraphs(F.col("sections")))).alias("fingerprint"), "sections")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: each document with the next in falling doc_id, the first after the last.

    Rows go once to windows of 2**ID_BITS neighbouring ids. What a window lacks is
    the row after its last: the top row of the next window that exists. These
    top rows (one in up to 1,024 rows) are sent into the windows above as well.
    """
    low = F.lit(-(2**63)).cast("long")
    d = id_text(docs).withColumn("id", F.coalesce("doc_id", low)).withColumn("win", F.shiftright("id", ID_BITS))
    wins = d.groupBy("win").agg(F.max("id").alias("top")).withColumn("far", F.shiftright("win", 12))
    # in two steps, so that what one task orders is a row for each 2**22 ids
    fars = wins.groupBy("far").agg(F.max("win").alias("high"), F.max_by("top", "win").alias("far_top"))
    order = Window.orderBy(F.col("far").desc())
    first = F.first("far_top").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = fars.select("far", F.coalesce(F.lead("far_top").over(order), first).alias("after"))
    inside = Window.partitionBy("far").orderBy(F.col("win").desc())
    lead = wins.withColumn("follows", F.lead("top").over(inside)).join(after, "far")
    heads = lead.select(F.col("win").alias("to"), F.coalesce("follows", "after").alias("id")).groupBy("id").agg(F.collect_list("to").alias("to"))
    if wins.count() <= BROADCAST_WINDOWS:
        heads = F.broadcast(heads)  # else the join shuffles
    sent = d.join(heads, "id").select("doc_id", "text", "id", F.explode("to").alias("win"), F.lit(True).alias("sent"))
    # a text's order among equal ids, then what was sent in last
    both = d.select("doc_id", "text", "id", "win", F.lit(False).alias("sent")).unionByName(sent)
    w = Window.partitionBy("win").orderBy(F.col("sent"), F.col("id").desc(), F.col("text"))
    return both.withColumn("next_text", F.lead("text").over(w)).where(~F.col("sent")).select("doc_id", "text", "next_text")


def edited_text(text: Column, following: Column) -> Column:
    """The last half (rounded down) replaced by as much of the start of the next text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, how like their trees are, and where they differ: how many
    paragraphs the edited text hasn't, and the first section and paragraph in it that differ (from 0; null if none do)."""
    d = with_next(docs).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("t"), tree(F.col("edited")).alias("e"), leaves(tree(F.col("next_text"))).alias("c"))
    d = d.select("*", leaves(F.col("t")).alias("a"), paragraphs(F.col("t")).alias("p"), leaves(F.col("e")).alias("b"), paragraphs(F.col("e")).alias("q"))
    d = d.select("*", branches(F.col("p")).alias("s"), branches(F.col("q")).alias("z")).withColumn("at", first_difference(F.col("s"), F.col("z")))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", root(F.col("s")).alias("fingerprint"), root(F.col("z")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), F.size(differing(F.col("p"), F.col("q"))).cast("long").alias("differing"),
        F.col("at").cast("long").alias("edit_section"), first_difference(F.coalesce(F.get("p", "at"), F.array().cast("array<string>")), F.coalesce(F.get("q", "at"), F.array().cast("array<string>"))).cast("long").alias("edit_paragraph"),
    )
