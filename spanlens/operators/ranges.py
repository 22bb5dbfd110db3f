"""Sets of line ranges: merged, joined, cut out of each other and measured; what was read against what was shown.

A set is an array of struct<lo, hi> (both ends included) in order, in which no two ranges touch.
`merged` makes sets of a table's ranges, each key's ranges first within pieces of the line axis, so
that what a task holds of a key follows the length of its file and not its number of rows.
The other functions are expressions on such arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = "array<struct<lo:int,hi:int>>"
PIECE = 4_096  # lines
NEAR = 100  # a line so close to one that was shown in full was an expansion of it
SHOWN = ("inlined", "mapped", "related")
HOOK_FILE = "/tool-results/hook-"  # fixed value: what was shown, kept as a file
_LEAST, _MOST = -(2**31), 2**31 - 1


def of(lo: Column, hi: Column) -> Column:
    """The set of one range; empty if it ends before it begins or an end is null."""
    return F.filter(F.array(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))), lambda r: r["lo"] <= r["hi"])


def none() -> Column:
    return F.array().cast(RANGES)


def normal(ranges: Column) -> Column:
    """The set of any array of ranges; null is the empty set."""
    given = F.array_sort(F.filter(F.coalesce(ranges, none()), lambda r: r["lo"] <= r["hi"]))

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))
        touches = (F.size(acc) > 0) & (r["lo"] <= last["hi"] + 1)
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(given, none(), step)


def union(a: Column, b: Column) -> Column:
    return normal(F.concat(F.coalesce(a, none()), F.coalesce(b, none())))


def intersect(a: Column, b: Column) -> Column:
    """What both sets hold."""
    met = lambda r: F.transform(b, lambda s: F.struct(F.greatest(r["lo"], s["lo"]).alias("lo"), F.least(r["hi"], s["hi"]).alias("hi")))
    return F.coalesce(F.flatten(F.transform(a, lambda r: F.filter(met(r), lambda s: s["lo"] <= s["hi"]))), none())


def gaps(a: Column) -> Column:
    """All lines that a set leaves out."""
    known = F.coalesce(a, none())
    before = F.concat(F.array(F.lit(_LEAST)), F.transform(known, lambda r: r["hi"] + 1))
    after = F.concat(F.transform(known, lambda r: r["lo"] - 1), F.array(F.lit(_MOST)))
    return F.filter(F.zip_with(before, after, lambda x, y: F.struct(x.alias("lo"), y.alias("hi"))), lambda r: r["lo"] <= r["hi"])


def subtract(a: Column, b: Column) -> Column:
    """What the first set holds and the second doesn't."""
    return intersect(a, gaps(b))


def padded(a: Column, by: int) -> Column:
    """Every range longer by so many lines on both sides."""
    return normal(F.transform(a, lambda r: F.struct((r["lo"] - by).alias("lo"), (r["hi"] + by).alias("hi"))))


def measure(a: Column) -> Column:
    """How many lines a set holds; 0 for null."""
    return F.coalesce(F.aggregate(a, F.lit(0), lambda n, r: n + r["hi"] - r["lo"] + 1), F.lit(0))


def holds(a: Column, line: Column) -> Column:
    return F.coalesce(F.exists(a, lambda r: line.between(r["lo"], r["hi"])), F.lit(False))


def merged(ranges: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", out: str = "ranges") -> DataFrame:
    """(keys, out): the set of each key's ranges."""
    rows = ranges.select(*keys, F.col(lo).cast("int").alias("_lo"), F.col(hi).cast("int").alias("_hi")).filter("_lo <= _hi")

    def islands(df: DataFrame, by: list) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("_lo", "_hi")
        reach = F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
        begins = df.withColumn("_new", (reach.isNull() | (F.col("_lo") > reach + 1)).cast("int"))
        numbered = begins.withColumn("_island", F.sum("_new").over(order))
        return numbered.groupBy(*by, "_island").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).drop("_island")

    pieces = islands(rows.withColumn("_piece", F.floor(F.col("_lo") / PIECE)), [*keys, "_piece"]).drop("_piece")
    item = F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    return islands(pieces, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(out))


def shown_sets(shown: DataFrame, session: str = "session", near: int = NEAR) -> DataFrame:
    """(session, path, inlined, nearby, listed): sets of what a session was shown of a file, each within the next.

    shown: (session, path, kind, lo, hi), a kind of `SHOWN`.
    """
    sets = merged(shown.withColumn("_whole", F.col("kind") == "inlined"), [session, "path", "_whole"])
    both = sets.groupBy(session, "path").agg(F.first(F.when(F.col("_whole"), F.col("ranges")), True).alias("inlined"), F.first(F.when(~F.col("_whole"), F.col("ranges")), True).alias("_listed"))
    both = both.withColumn("inlined", F.coalesce("inlined", none())).withColumn("nearby", padded(F.col("inlined"), near))
    return both.select(session, "path", "inlined", "nearby", union(F.col("nearby"), F.col("_listed")).alias("listed"))


def read_classes(reads: DataFrame, shown: DataFrame, gold: DataFrame, session: str = "session", near: int = NEAR) -> DataFrame:
    """The reads (session, path, lo, hi, ...) with the lines of each by class, the first that fits.

    redundant: shown in full; expansion: within `near` lines of that; map_hit: only listed; map_file: elsewhere in
    a file of which something was shown; gold_miss: in a file that mattered and was not shown; hook_file: what was
    shown, read again from a file; other.  Also `lines`, and `is_gold`: the file mattered.
    """
    sets = shown_sets(shown, session, near)
    mattered = gold.select(session, "path").distinct().withColumn("_gold", F.lit(True))
    own = of(F.col("lo"), F.col("hi"))
    rows = reads.join(sets, [session, "path"], "left").join(mattered, [session, "path"], "left").withColumn("lines", measure(own))
    for name in ("inlined", "nearby", "listed"):
        rows = rows.withColumn(f"_{name}", measure(intersect(own, F.col(name))))
    hook = F.contains("path", F.lit(HOOK_FILE))
    known, is_gold = F.col("listed").isNotNull(), F.coalesce("_gold", F.lit(False))
    rest = F.col("lines") - F.col("_listed")
    classes = {
        "redundant": F.col("_inlined"),
        "expansion": F.col("_nearby") - F.col("_inlined"),
        "map_hit": F.col("_listed") - F.col("_nearby"),
        "map_file": F.when(known, rest).otherwise(0),
        "gold_miss": F.when(~known & is_gold, rest).otherwise(0),
        "other": F.when(~known & ~is_gold, rest).otherwise(0),
    }
    counted = [F.when(hook, 0).otherwise(n).alias(c) for c, n in classes.items()]
    return rows.select(*reads.columns, "lines", *counted, F.when(hook, F.col("lines")).otherwise(0).alias("hook_file"), (is_gold & ~hook).alias("is_gold"))


CLASSES = ("redundant", "expansion", "map_hit", "map_file", "gold_miss", "hook_file", "other")


def class_fraction(classes: list[str]) -> Column:
    """The part of a read's lines (from `read_classes`) that is of these classes."""
    return sum((F.col(c) for c in classes[1:]), F.col(classes[0])) / F.greatest("lines", F.lit(1))


def range_fraction(lo: Column, hi: Column, ranges: Column) -> Column:
    """The part of a read's lines that a set holds."""
    return measure(intersect(of(lo, hi), ranges)) / F.greatest(hi - lo + 1, F.lit(1))


def removed(calls: DataFrame, fraction: Column, keys: list[str], turn: str = "turn", tokens: str = "tokens", seconds: str = "seconds", least: float = 0.8) -> DataFrame:
    """(keys, turns, tokens_saved, turns_saved, seconds_saved): what a session saves if `fraction` of each call was not needed.

    A turn goes only if at least `least` of each of its calls does.  seconds: how long the call's turn took.
    """
    per = calls.withColumn("_f", F.coalesce(fraction, F.lit(0.0))).groupBy(*keys, turn)
    turns = per.agg(F.min("_f").alias("_least"), F.sum(F.col(tokens) * F.col("_f")).alias("_tokens"), F.max(seconds).alias("_seconds"))
    goes = F.col("_least") >= least
    return turns.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        F.sum("_tokens").alias("tokens_saved"),
        F.count_if(goes).alias("turns_saved"),
        F.sum(F.when(goes, F.coalesce("_seconds", F.lit(0.0))).otherwise(0.0)).alias("seconds_saved"),
    )


def inline_more(calls: DataFrame, shown: DataFrame, ks: list[int], session: str = "session", full: int = 3, write_price: float = 3.75, read_price: float = 0.3) -> DataFrame:
    """(session, k, turns, tokens_saved, turns_saved, seconds_saved, tokens_added, cost_added) if the first k listed spans were shown in full.

    calls: (session, path, lo, hi, turn, tokens, seconds); shown: (session, path, kind, lo, hi, rank, tokens).  Listed
    spans of ranks above `full` up to k count, unless that very range is shown in full already.  What is added is
    written once and read again on each turn that stays, at prices for a million tokens.
    """
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    done = shown.filter("kind = 'inlined'").select(session, "path", "lo", "hi")
    extra = shown.filter((F.col("kind") == "mapped") & (F.col("rank") > full)).join(done, [session, "path", "lo", "hi"], "left_anti").select("*", k).filter("rank <= k")
    added = extra.groupBy(session, "k").agg(F.sum("tokens").alias("tokens_added"))
    sets = merged(extra, [session, "k", "path"])
    rows = calls.select("*", k).join(sets, [session, "k", "path"], "left")
    saved = removed(rows, range_fraction(F.col("lo"), F.col("hi"), F.col("ranges")), [session, "k"])
    stay = F.greatest(F.col("turns") - F.col("turns_saved"), F.lit(1)) - 1
    cost = F.col("tokens_added") * (write_price + read_price * stay) / 1e6
    return saved.join(added, [session, "k"], "left").withColumn("tokens_added", F.coalesce("tokens_added", F.lit(0))).withColumn("cost_added", F.coalesce(cost, F.lit(0.0)))


def gold_coverage(gold: DataFrame, shown: DataFrame, session: str = "session") -> DataFrame:
    """(session, path, covered): the best way in which a file that mattered was shown, or absent."""
    names = F.array(*map(F.lit, SHOWN))
    best = shown.groupBy(session, "path").agg(F.min(F.array_position(names, F.col("kind"))).alias("_best"))
    return gold.select(session, "path").distinct().join(best, [session, "path"], "left").select(session, "path", F.coalesce(F.try_element_at(names, F.col("_best").cast("int")), F.lit("absent")).alias("covered"))


def lookup_coverage(hits: DataFrame, named: DataFrame, cited: DataFrame, got: DataFrame, lookup: str = "lookup") -> DataFrame:
    """(lookup, n_used, line_cov, cited_cov, file_cov): how much of what was used of a lookup another answer holds.

    hits: (lookup, path, line) of the lookup; named: (lookup, path) files that the final answer named; cited: (lookup,
    line) line numbers it named; got: (lookup, path, lo, hi) of the other answer (lines, or files alone: null ends).
    Used are the hits in named files; all hits, if there are none.  Used files are the named ones; those with hits, if
    there are none.  A fraction of nothing is null.
    """
    sets = merged(got, [lookup, "path"])
    files = got.select(lookup, "path").distinct().withColumn("_got", F.lit(True))
    in_named = named.select(lookup, "path").distinct().withColumn("_named", F.lit(True))
    in_cited = cited.select(lookup, "line").distinct().withColumn("_cited", F.lit(True))
    rows = hits.select(lookup, "path", "line").join(in_named, [lookup, "path"], "left").join(in_cited, [lookup, "line"], "left").join(sets, [lookup, "path"], "left")
    rows = rows.withColumn("_have", holds(F.col("ranges"), F.col("line")).cast("int"))
    part = lambda keep: F.struct(F.count_if(keep).alias("n"), F.sum(F.when(keep, F.col("_have"))).alias("have"), F.count_if(keep & F.col("_cited")).alias("n_cited"), F.sum(F.when(keep & F.col("_cited"), F.col("_have"))).alias("have_cited"))
    per = rows.groupBy(lookup).agg(part(F.col("_named").isNotNull()).alias("_in"), part(F.lit(True)).alias("_all"))
    used = F.when(F.col("_in.n") > 0, F.col("_in")).otherwise(F.col("_all"))
    lines = per.select(lookup, used.alias("u")).select(lookup, F.col("u.n").alias("n_used"), (F.col("u.have") / F.nullif(F.col("u.n"), F.lit(0))).alias("line_cov"), (F.col("u.have_cited") / F.nullif(F.col("u.n_cited"), F.lit(0))).alias("cited_cov"))
    own = hits.select(lookup, "path").distinct().join(in_named.select(lookup).distinct(), lookup, "left_anti")
    wanted = in_named.select(lookup, "path").unionByName(own).join(files, [lookup, "path"], "left")
    by_file = wanted.groupBy(lookup).agg(F.avg(F.when(F.col("_got"), 1.0).otherwise(0.0)).alias("file_cov"))
    return lines.join(by_file, lookup, "full")


def coverage_report(covered: DataFrame, group: str) -> DataFrame:
    """(group, lookups, line_cov, cited_cov, file_cov, full): means of the fractions there are, and lookups covered whole."""
    whole = (F.coalesce("line_cov", F.lit(1.0)) == 1.0) & (F.coalesce("file_cov", F.lit(1.0)) == 1.0)
    means = [F.avg(c).alias(c) for c in ("line_cov", "cited_cov", "file_cov")]
    return covered.groupBy(group).agg(F.count("*").alias("lookups"), *means, F.count_if(whole).alias("full"))


def parse_shown(text: Column) -> Column:
    """array<struct<kind, path, lo, hi, rank>> of what a rendered block shows: spans in full, ranked locations, related.

    The reverse of rendering: headings "### path:a-b" outside fences are spans in full; after "Ranked locations:" lines
    "1. path — a-b name; c-d" are listed with their ranks; after "Related by references:" lines "- path:a-b name — why".
    """
    kinds = "array<struct<kind:string,path:string,lo:int,hi:int,rank:int>>"
    start = F.struct(F.lit("").alias("section"), F.lit(False).alias("fenced"), F.lit(0).alias("rank"), F.array().cast(kinds).alias("out"))

    def span(kind: str, path: Column, a: Column, b: Column, rank: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), path.alias("path"), a.cast("int").alias("lo"), b.cast("int").alias("hi"), rank.cast("int").alias("rank"))

    def step(acc: Column, line: Column) -> Column:
        fence, open_ = F.startswith(line, F.lit("```")), acc["fenced"]
        head, item, back = r"^### (\S+?):([0-9]+)-([0-9]+)( .*)?$", r"^[0-9]+\. (\S+) — (.*)$", r"^- (\S+?):([0-9]+)-([0-9]+)( .*)? — .*$"
        at = lambda pattern, n: F.regexp_extract(line, pattern, n)
        places = F.filter(F.split(at(item, 2), "; "), lambda p: p.rlike("^ *[0-9]+-[0-9]+"))
        listed = F.transform(places, lambda p, i: span("mapped", at(item, 1), F.regexp_extract(p, "^ *([0-9]+)-([0-9]+)", 1), F.regexp_extract(p, "^ *([0-9]+)-([0-9]+)", 2), acc["rank"] + i + 1))
        found = (
            F.when(open_, F.array().cast(kinds))
            .when(line.rlike(head), F.array(span("inlined", at(head, 1), at(head, 2), at(head, 3), F.lit(None))))
            .when((acc["section"] == "map") & line.rlike(item), listed)
            .when((acc["section"] == "related") & line.rlike(back), F.array(span("related", at(back, 1), at(back, 2), at(back, 3), F.lit(None))))
            .otherwise(F.array().cast(kinds))
        )
        section = (
            F.when(open_, acc["section"])
            .when(F.startswith(line, F.lit("Ranked locations:")), "map")
            .when(F.startswith(line, F.lit("Related by references:")), "related")
            .when(F.startswith(line, F.lit("### ")), "")
            .otherwise(acc["section"])
        )
        more = F.size(F.filter(found, lambda s: s["kind"] == "mapped"))
        return F.struct(section.alias("section"), F.when(fence, ~open_).otherwise(open_).alias("fenced"), (acc["rank"] + more).alias("rank"), F.concat(acc["out"], found).alias("out"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: acc["out"])
