"""Repeated passages: content-defined chunks of lines, found by hash, compared by bytes; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.text import fresh, split_by
from tracewell.scratch import discard, written

#: A line's rolling hash covers it and the WINDOW - 1 lines before it.
WINDOW, DIVISOR = 2, 2
#: A repeated passage of more words than this goes, however its lines fall into chunks.
PASSAGE = 50


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, also where then uses it inside another function of array elements."""
    return F.get(F.transform(F.array(value), then), 0)


def chunks(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """array<struct<text, many, hash>>: the chunks of a text, in a form that `unflagged` turns back, whether they have
    several lines, and their hash. Null for a null text.

    A chunk ends after a line whose rolling hash is 0 modulo divisor while that of the line before isn't, so all
    chunks but a text's last have two lines or more, and boundaries move with their lines. The work is linear in the
    text: lines are joined again with a sign before each but the first, b where it begins a chunk and c where it goes
    on with one, and split before the b.
    """

    def line(x: Column) -> Column:
        return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")

    def rolled(hashes: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            total = x
            for k in range(1, window):
                total = total + F.when(i >= k, F.get(hashes, F.greatest(i - k, F.lit(0)))).otherwise(0) * 31**k
            return F.pmod(total, F.lit(divisor))

        return F.transform(hashes, one)

    def flagged(lines: Column, roll: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            ended = (i > 1) & (F.get(roll, F.greatest(i - 1, F.lit(0))) == 0) & (F.get(roll, F.greatest(i - 2, F.lit(0))) != 0)
            return F.concat(F.when(i == 0, "").when(ended, "b").otherwise("c"), x)

        return F.array_join(F.transform(lines, one), "\n")

    def part(x: Column) -> Column:
        return F.struct(x.alias("text"), F.contains(x, F.lit("\n")).alias("many"), F.xxhash64(x).alias("hash"))

    def parts(lines: Column) -> Column:
        return let(F.transform(lines, line), lambda hashes: let(rolled(hashes), lambda roll: F.transform(F.split(flagged(lines, roll), "\nb", -1), part)))

    return let(F.split(text, "\n", -1), parts)


def unflagged(parts: Column) -> Column:
    """The text of chunks that stand one after the other."""
    return F.regexp_replace(F.array_join(parts, "\nb"), "\n[bc]", "\n")


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_cols: bool = False) -> DataFrame:
    """docs, all columns and rows, their texts without the multi-line chunks that stand in an earlier place as well.

    Of equal chunks the one with the smallest (doc_id, text hash, place in the text) stays; nulls come first. Of rows
    alike in id and text one, whichever is read first, is the earlier. Chunks of one line always stay. Where n_chars is
    a column it becomes the new length. A null text stays null; a text of which nothing is left becomes empty. With
    count_cols the result also has n_chunks and n_removed. An empty table gives an empty result.

    Chunks meet by a hash of their line hashes, without their text; hashes found once go no further. The bytes of the
    others are compared (least and greatest text under a hash are equal), and under a hash with different texts
    nothing is removed. A chunk in a third of all texts is one row of each task before it is shuffled.
    """
    version_of = F.xxhash64(text_col)
    own = docs.select(F.col(id_col).alias("id"), version_of.alias("v"), F.posexplode(chunks(F.col(text_col))).alias("at", "c"))
    light = written(own.where("c.many").select("id", "v", "at", F.col("c.hash").alias("h")), "chunks")
    first = light.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "v", "at")).alias("first")).where("n > 1")
    first = written(first, "first")  # read back, both sides of the join below can be split where a hash is very common
    seen = light.join(first, "h").select("id", "v", "at", (~F.struct("id", "v", "at").eqNullSafe(F.col("first"))).alias("later"))
    key, version, again, later, twice, rest, row, leader = fresh(docs.columns, "key", "version", "again", "later", "twice", "rest", "row", "leader")
    marks = seen.groupBy(F.col("id").alias(key), F.col("v").alias(version)).agg(F.collect_set("at").alias(again), F.collect_set(F.when(F.col("later"), F.col("at"))).alias(later), F.count("*").alias(twice))
    marks = written(marks.withColumn(twice, F.col(twice) > F.size(again)), "marks")  # several rows have this id and text
    discard(light, first)
    some, none = split_by(docs, F.xxhash64(F.col(id_col), version_of), marks, F.xxhash64(key, version))
    no_marks = F.lit(None).cast("array<int>")
    # By sorting at every size, as it must be at the sizes that count: there are as many marks as texts with repeats.
    met = some.join(marks.hint("merge"), F.col(id_col).eqNullSafe(F.col(key)) & (version_of == F.col(version)), "left").unionByName(none.withColumns({key: F.lit(None).cast(docs.schema[id_col].dataType), version: F.lit(None).cast("long"), again: no_marks, later: no_marks, twice: F.lit(None).cast("boolean")}))
    met = written(met.withColumn(row, F.monotonically_increasing_id()), "marked")
    if not marks.where(twice).isEmpty():
        alike = met.where(twice)
        leaders = written(alike.groupBy(key, version).agg(F.min(row).alias(leader)).select(leader), "leaders")
        alike = alike.join(leaders, F.col(row) == F.col(leader), "left").withColumn(later, F.when(F.col(leader).isNull(), F.col(again)).otherwise(F.col(later))).drop(leader)
        met = met.where(~F.coalesce(twice, F.lit(False))).unionByName(alike)
    discard(marks)

    found = met.where(F.col(again).isNotNull()).select(F.explode(let(chunks(F.col(text_col)), lambda cs: F.transform(again, lambda i: F.get(cs, i)))).alias("c")).select("c.hash", "c.text")
    unlike = written(found.groupBy("hash").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("hash"), "unlike")
    gone = F.coalesce(later, F.array().cast("array<int>"))
    # Hashes under which texts differ: none but by chance in very many chunks, so a handful.
    apart = [r[0] for r in unlike.collect()]

    def left(cs: Column) -> Column:
        own = F.filter(gone, lambda i: ~F.get(cs, i)["hash"].isin(apart)) if apart else gone

        def build(kept: Column) -> Column:
            joined = F.when(F.size(kept) < F.size(cs), unflagged(F.transform(kept, lambda i: F.get(cs, i)["text"])))
            return F.struct(joined.alias("text"), F.size(cs).alias("n"), F.size(kept).alias("kept"))

        return let(F.array_except(F.sequence(F.lit(0), F.size(cs) - 1), own), build)

    out = met.withColumn(rest, let(chunks(F.col(text_col)), left))
    n_gone = F.coalesce(F.col(f"{rest}.n") - F.col(f"{rest}.kept"), F.lit(0))
    new = {text_col: F.when(n_gone > 0, F.col(f"{rest}.text")).otherwise(F.col(text_col))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(new[text_col]).cast(docs.schema["n_chars"].dataType)
    cols = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns]
    if count_cols:
        cols += [F.coalesce(f"{rest}.n", F.lit(0)).cast("long").alias("n_chunks"), n_gone.cast("long").alias("n_removed")]
    return out.select(*cols)


#: More lines than a passage can have: tells line counts from word counts in one number.
_LINES = 1 << 20


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PASSAGE) -> DataFrame:
    """docs, all columns and rows, their texts without runs of lines of over `least` words that stand in an earlier place.

    A line goes if it lies in a run of over `least` words that an earlier place has line for line, as a whole. Places are
    ordered by doc_id (nulls first), text hash and line; rows alike in both ids and texts are one place, and every line
    stays where it stands first. Null texts and n_chars are as in drop_repeated_chunks.

    From every line the shortest run of over `least` words forward, and that back, are compared: a repeated passage of any
    length is the union of such runs inside it, all of which the earlier place has too. They are formed only from lines
    that stand beside the same neighbour elsewhere, or have over `least` words and stand elsewhere; lines and runs meet by
    hashes, runs by 128 bits, without their text.
    """
    text = F.col(text_col)

    def measured(lines: Column) -> Column:
        return F.transform(lines, lambda x: F.struct(F.regexp_count(x, F.lit("[^\\x20\\x09-\\x0D]+")).alias("w"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g")))

    own = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("v"), let(F.split(text, "\n", -1), measured).alias("ls"))
    light = written(own, "lines")

    def pairs(ls: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            two = F.when(i + 1 < F.size(ls), F.struct(i.alias("at"), F.lit(2).alias("n"), F.xxhash64(x["h"], F.get(ls, i + 1)["h"]).alias("k")))
            alone = F.when(x["w"] > least, F.struct(i.alias("at"), F.lit(1).alias("n"), F.xxhash64(x["h"]).alias("k")))
            return F.array(two, alone)

        return F.array_compact(F.flatten(F.transform(ls, one)))

    met = light.select("id", "v", F.inline(pairs(F.col("ls"))))
    many = written(met.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k"), "many")
    near = met.join(many, "k", "left_semi").groupBy("id", "v").agg(F.collect_set(F.struct("at", "n")).alias("near"))
    at = F.array_distinct(F.flatten(F.transform("near", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))
    own_lines = near.select(F.col("id").alias("i"), F.col("v").alias("j"), at.alias("ats"))
    lines = own_lines.join(light, F.col("i").eqNullSafe(F.col("id")) & (F.col("j") == F.col("v"))).select("id", "v", F.explode("ats").alias("at"), "ls")
    lines = lines.select("id", "v", "at", F.get("ls", F.col("at")).alias("l")).select("id", "v", "at", "l.w", "l.h", "l.g").distinct()
    lines = lines.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("id", "v").orderBy("at")))
    one = Window.partitionBy("id", "v", "run")
    step = F.col("w") * F.lit(_LINES).cast("long") + 1  # words, then lines: no two lines of a run have one sum
    lines = lines.withColumn("all", F.sum("w").over(one)).where(F.col("all") > least).withColumn("upto", F.sum(step).over(one.orderBy("at"))).withColumn("from", F.col("upto") - step)
    reach = (least + 1) * _LINES - 1

    def runs(frame: Window) -> DataFrame:
        key = [F.xxhash64(F.collect_list("h").over(frame)).alias("h"), F.xxhash64(F.collect_list("g").over(frame)).alias("g")]
        return lines.select("id", "v", F.min("at").over(frame).alias("a"), F.max("at").over(frame).alias("b"), *key, F.sum("w").over(frame).alias("w")).where(F.col("w") > least).drop("w")

    found = written(runs(one.orderBy("from").rangeBetween(0, reach)).unionByName(runs(one.orderBy("upto").rangeBetween(-reach, 0))).distinct(), "runs")
    place = F.struct("id", "v", "a")
    first = written(found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "g", "first"), "first")
    later = found.join(first, ["h", "g"]).where(~place.eqNullSafe(F.col("first")))
    key, version, gone = fresh(docs.columns, "key", "again", "later")
    marks = written(later.groupBy(F.col("id").alias(key), F.col("v").alias(version)).agg(F.collect_set(F.struct("a", "b")).alias(gone)), "passages")

    def left(lines: Column) -> Column:
        out = F.array_distinct(F.flatten(F.transform(gone, lambda x: F.sequence(x["a"], x["b"]))))
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out), lambda i: F.get(lines, i)), "\n")

    discard(light, many, found, first)
    some, none = split_by(docs, F.xxhash64(F.col(id_col), F.xxhash64(text)), marks, F.xxhash64(key, version))
    out = some.join(marks.hint("merge"), F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(version)), "left")
    out = out.unionByName(none.withColumns({key: F.lit(None).cast(docs.schema[id_col].dataType), version: F.lit(None).cast("long"), gone: F.lit(None).cast(marks.schema[gone].dataType)}))
    new = {text_col: F.when(F.col(gone).isNotNull(), let(F.split(text, "\n", -1), left)).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(gone).isNotNull(), F.char_length(new[text_col]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
