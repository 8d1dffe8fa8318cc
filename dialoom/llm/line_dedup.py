"""Line dedup: winnowing over line hashes, in DataFrame functions only.

A *unit* is a line (split at ``\\n``) with at least one word, compared after trimming white space.
Documents are read in the order (doc_id, text hash); within one, lines from the top. A line is removed
if and only if it lies in a run of consecutive units with at least ``min_words`` words in total that
occurs, unit for unit, at an earlier place, in this or an earlier document (occurrences may overlap).

1. Window minima. For each unit there is the shortest window with ``min_words`` words that begins with it, and the
   one that ends with it. The unit with the smallest line hash in a window (the first of equals) is *selected*. Neighbouring
   windows mostly select the same unit, so the selected positions are sparse. A repeated run holds whole windows, and which of
   its units a window selects depends on its content alone: each repeated run has a selected position, with the same hash, the
   fingerprint, as at its earlier place. Each position is one row, with the windows that select it and their units (a second hash).
2. Positions are joined on the fingerprint with the first place of that fingerprint. One that occurs once ends there.
3. Extension. From a position and its first place the match is extended unit by unit to the left and to the right, as far as the
   windows reach. A match of ``min_words`` words is a repeated run and goes; windows inside it are settled.
4. A window that the first place does not match (a common line in another context) is held against the other places of its
   fingerprint: those that agree in all its units have a first place of their own, the others go. A window whose
   units are those of the first place is settled in step 3 wherever it occurs, so nothing is missed and no pairs of
   occurrences are made, however often a passage occurs.
5. Runs of a document are merged to disjoint intervals of lines, and these lines are deleted.

The first occurrence of any line content is always kept, so no line vanishes from the corpus. Equality is that of two
64-bit hashes: the fingerprint's and, for every unit of the window, one with another seed.

Defined cases: a null text stays null, an empty text stays empty, blank lines stay, rows that repeat
(doc_id, text) are one document whose decision holds for each of the rows, a null doc_id comes first in
the order, an empty table gives an empty table. Very long texts are a row of arrays, each worked through once, in time linear in
the lines. Of equal line hashes in a window the first counts. Extra columns pass through; ``n_lines``, ``n_removed`` and
``removed`` are taken over if docs has them, and no other name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, n_words, written

#: Repeated runs of fewer words stay: boilerplate of a line or two is no repeated passage.
MIN_WORDS = 50


def _units(docs: DataFrame) -> DataFrame:
    """(doc, version, line, hash, other, words): one row for each line with a word, once for each distinct document."""
    # The text's hash is taken before its lines become rows, which would take it once for each of them.
    texts = docs.filter(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), F.split("text", "\n", -1).alias("lines")
    )
    lines = texts.select("doc", "version", F.posexplode("lines").alias("line", "content"))
    content = F.regexp_replace("content", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    units = lines.select(
        "doc", "version", "line", F.xxhash64(content).alias("hash"), F.xxhash64(F.lit(1), content).alias("other"),
        n_words(F.col("content")).cast("int").alias("words"),
    ).filter("words > 0")
    # One exchange by document serves the removal of repeated rows, the windows and the positions.
    return (
        units.repartition("doc", "version")
        .groupBy("doc", "version", "line")
        .agg(F.first("hash").alias("hash"), F.first("other").alias("other"), F.first("words").alias("words"))
    )


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _positions(units: DataFrame, min_words: int) -> DataFrame:
    """(doc, version, at, fingerprint, low, around, windows): a row for each selected unit.

    at: its number among the document's units; around: the units from number low on that its windows hold; windows: their
    first and last numbers.
    """
    in_doc = Window.partitionBy("doc", "version").orderBy("line")
    placed = units.withColumn("through", F.sum("words").over(in_doc)).withColumn("n", F.row_number().over(in_doc))
    placed = placed.withColumn("before", F.col("through") - F.col("words"))
    onward = Window.partitionBy("doc", "version").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("doc", "version").orderBy("through").rangeBetween(-(min_words - 1), 0)

    def window(frame, first: Column, last: Column) -> Column:
        whole = F.sum("words").over(frame) >= min_words
        return F.when(whole, F.struct(F.min(F.struct("hash", "n")).over(frame).n.alias("at"), first.alias("first"), last.alias("last")))

    placed = placed.withColumn("from", window(onward, F.col("n"), F.max("n").over(onward)))
    placed = placed.withColumn("to", window(back, F.min("n").over(back), F.col("n")))
    # From here on elements are read one by one: slice() would copy a long document's array for each position.
    whole = placed.groupBy("doc", "version").agg(
        F.sort_array(F.collect_list(F.struct("n", "line", "hash", "other", "words"))).alias("units"),
        F.sort_array(F.flatten(F.collect_list(F.filter(F.array("from", "to"), lambda w: w.isNotNull())))).alias("windows"),
    ).filter(F.size("windows") > 0)
    windows, units_ = F.col("windows"), F.col("units")
    # Windows are in the order of what they select; a group begins where that changes.
    begins = F.filter(
        F.sequence(F.lit(0), F.size(windows) - 1),
        lambda i: (i == 0) | (F.get(windows, i).at != F.get(windows, i - 1).at),
    )

    def position(begin: Column, following: Column) -> Column:
        own = F.transform(F.sequence(begin, following - 1), lambda i: F.get(windows, i))
        low, high = F.array_min(F.transform(own, lambda w: w["first"])), F.array_max(F.transform(own, lambda w: w["last"]))
        at = F.get(windows, begin).at
        around = F.transform(F.sequence(low - 1, high - 1), lambda i: F.struct(*[F.get(units_, i)[x].alias(x) for x in ("line", "other", "words")]))
        return F.struct(
            at.alias("at"), F.get(units_, at - 1).hash.alias("fingerprint"), low.alias("low"), around.alias("around"),
            F.transform(own, lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last"))).alias("windows"),
        )

    selected = _bound(begins, lambda b: F.transform(b, lambda begin, i: position(begin, F.coalesce(F.get(b, i + 1), F.size(windows)))))
    return whole.select("doc", "version", F.explode(selected).alias("p")).select("doc", "version", "p.*")


def _equal_for(own: Column, first: Column, own_at: Column, first_at: Column, step: int) -> Column:
    """How many units equal each other in one direction from two positions on, the positions not counted."""
    most = F.least(own_at, first_at) if step < 0 else F.least(F.size(own) - own_at, F.size(first) - first_at) - 1
    steps = F.when(most > 0, F.sequence(F.lit(1), F.greatest(most, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    differs = F.transform(steps, lambda k: F.get(own, own_at + k * step).other != F.get(first, first_at + k * step).other)
    place = F.array_position(differs, F.lit(True))
    return F.when(place > 0, place - 1).otherwise(most).cast("int")


def _matches(positions: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Runs (doc, version, first, last) of line numbers that first places match, and the windows that these leave open."""
    place = F.struct("doc", "version", "at")
    shared = positions.groupBy("fingerprint").agg(F.min(place).alias("origin"), F.max(place).alias("latest")).filter("origin != latest")
    # Tables of minima are written, so that a passage that very many documents hold only meets its row in a join, which Spark can split.
    shared = written(shared.select("fingerprint", "origin"), "line-origins")
    met = written(positions.join(shared, "fingerprint").withColumn("is_first", place == F.col("origin")), "line-positions")
    origins = met.filter("is_first").select(
        "fingerprint", F.col("around").alias("first_around"), (F.col("at") - F.col("low")).alias("first_at")
    )
    own_at = F.col("at") - F.col("low")
    pairs = met.filter("NOT is_first").join(origins, "fingerprint").withColumn("own_at", own_at)
    same = F.get("around", F.col("own_at")).other == F.get("first_around", F.col("first_at")).other
    reach = [_equal_for(F.col("around"), F.col("first_around"), F.col("own_at"), F.col("first_at"), step) for step in (-1, 1)]
    pairs = pairs.withColumn("left", F.when(same, reach[0])).withColumn("right", F.when(same, reach[1]))
    run = F.when(same, F.slice("around", F.col("own_at") - F.col("left") + 1, F.col("left") + F.col("right") + 1))
    words = F.aggregate(run, F.lit(0), lambda total, u: total + u.words)
    extended = pairs.select(
        "doc", "version", "fingerprint", "low", "around", "windows", (F.col("at") - F.col("left")).alias("a"), (F.col("at") + F.col("right")).alias("b"),
        F.when(words >= min_words, F.struct(F.get(run, F.lit(0)).line.alias("first"), F.element_at(run, -1).line.alias("last"))).alias("run"),
    )
    unsettled = F.filter("windows", lambda w: ~F.coalesce((w["first"] >= F.col("a")) & (w["last"] <= F.col("b")), F.lit(False)))
    extended = written(
        extended.select("doc", "version", "fingerprint", "low", F.when(F.size(unsettled) > 0, F.col("around")).alias("around"), unsettled.alias("windows"), "run"),
        "line-matches",
    )
    runs = extended.filter("run IS NOT NULL").select("doc", "version", "run.*")
    left = extended.filter(F.size("windows") > 0).select("doc", "version", "fingerprint", "low", "around", F.explode("windows").alias("w"))
    return runs, left.select("doc", "version", "fingerprint", F.slice("around", F.col("w.first") - F.col("low") + 1, F.col("w.last") - F.col("w.first") + 1).alias("units"))


def _other_places(windows: DataFrame) -> DataFrame:
    """(doc, version, first, last): open windows that have an earlier place among the open windows of their fingerprint."""
    content = F.transform("units", lambda u: u.other)
    named = windows.select(
        "doc", "version", "fingerprint", content.alias("content"), F.get("units", F.lit(0)).line.alias("first"), F.element_at("units", -1).line.alias("last")
    ).distinct()
    named = written(named, "open-windows")
    place = F.struct("doc", "version", "first")
    earliest = named.groupBy("fingerprint", "content").agg(F.min(place).alias("origin"), F.max(place).alias("latest")).filter("origin != latest")
    later = named.join(written(earliest.select("fingerprint", "content", "origin"), "open-origins"), ["fingerprint", "content"])
    return later.filter(place != F.col("origin")).select("doc", "version", "first", "last")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, version, removed): disjoint intervals (first, last) of line numbers from 0 that later repeated runs cover, in order."""
    positions = written(_positions(_units(docs), min_words), "line-minima")
    runs, windows = _matches(positions, min_words)
    runs = runs.union(_other_places(windows)).distinct()
    in_doc = Window.partitionBy("doc", "version").orderBy("first", "last")
    reached = F.max("last").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("begins", F.when(F.col("first") <= reached, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("begins").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc", "version", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("doc", "version").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text shortened, and ``n_lines`` (lines before), ``n_removed`` and ``removed`` (line numbers from 0)."""
    doc, version, gone, answer = (free_name(docs, x) for x in ("_doc", "_version", "_gone", "_answer"))
    removals = repeated_lines(docs, min_words).select(
        F.col("doc").alias(doc), F.col("version").alias(version), F.col("removed").alias(gone)
    )
    left = docs.withColumn(version, F.xxhash64("text"))
    joined = left.join(
        removals, left.doc_id.eqNullSafe(removals[doc]) & (left[version] == removals[version]), "left"
    ).drop(removals[version])
    covered = F.flatten(F.transform(gone, lambda x: F.sequence(x["first"], x["last"])))

    def without(lines: Column) -> Column:
        # A removed run is given by its first and last unit; blank lines between them stay.
        def parts(removed: Column) -> Column:
            stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
            return F.struct(F.size(lines).alias("n"), removed.alias("removed"), F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n").alias("text"))

        return _bound(F.filter(covered, lambda i: F.get(lines, i).rlike(WORD)), parts)

    shortened = joined.withColumn(answer, F.when(F.col(gone).isNotNull(), _bound(F.split("text", "\n", -1), without)))
    before = F.coalesce(F.col(f"{answer}.n"), F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    removed = F.coalesce(F.col(f"{answer}.removed"), F.array().cast("array<int>"))
    return (
        shortened.withColumn("n_lines", before)
        .withColumn("removed", removed)
        .withColumn("n_removed", F.size("removed").cast("long"))
        .withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.col(f"{answer}.text")))
        .drop(doc, version, gone, answer)
    )
