"""Near-duplicates by bottom-k sketches of one hash function.

A text's set is its distinct word shingles; its sketch the k smallest hashes of
them.  Texts with equal sets are one class, and only class representatives go
on.  Inverted lists of retained values generate candidate pairs, the sketch of
a pair's union estimates its similarity and drops what can't reach the
threshold, and the full sets confirm the rest.

No link is lost to skew, and no list is expanded into all its pairs:

* A pair at the threshold shares at least ``need`` retained values (but for a
  chance of 1e-10), so it meets in the first ``k - need + 1`` values of any
  common order (``LISTS`` long lists at most, chance 1e-9).  The order puts values of many texts ("hot", on lists longer
  than ``LONG``) last; texts that only share a licence or a menu never meet.
* Lists up to ``LONG`` give their pairs.  A hot list gives each member's pair
  with a few leaders of the list, which joins groups of near copies; then only
  pairs between different components are compared, block by block over many
  tasks, and only those that the sketches admit become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import checked, cut, fresh, only, ranked, text_key, tidy, within, without
from carelake.llm.graph import components
from carelake.llm.words import NON_SPACE, shingle_set, words

K = 64
SHINGLE = 5
PERCENT = 85
LONG = 32     # longest list whose pairs are all made
PAIRS = 64    # pairs whose sets a worker holds at a time
LISTS = 16    # long lists of a text
BLOCK = 1024  # members of a long list that one task compares with as many others
MISS = 1e-10


def least_matches(m: int, percent: int, miss: float = MISS) -> int:
    """The largest x such that fewer than x of m samples of a union hit the intersection with chance <= miss."""
    p, below, x = percent / 100, 0.0, 0
    while x < m:
        below += math.comb(m, x) * p ** x * (1 - p) ** (m - x)
        if below > miss:
            break
        x += 1
    return x


def sketches(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n, digest, sketch): set size, a 128-bit digest of the set, and its k smallest hashes in order.

    Null and empty texts: n = 0, null digest, empty sketch.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for w in words(batch.column(1), NON_SPACE):
                n, digest, values = [], [], []
                for r in range(w.hi - w.lo):
                    s = shingle_set(w.hash[w.row(r)], shingle)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    values.append((s[:k] >> np.uint64(1)).astype(np.int64))
                offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
                flat = np.concatenate(values) if values else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.lo, w.hi - w.lo), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n", "digest", "sketch"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, sketch array<long>")


def _need(n: Column, k: int, percent: int) -> Column:
    """Retained values that a text with n shingles shares, at least, with any similar text."""
    return F.least(F.ceil(n * percent / 100.0).cast("int"), F.lit(least_matches(k, percent)))


def admitted(a: Column, b: Column, na: Column, nb: Column, k: int, percent: int) -> Column:
    """Can the pair reach the threshold, by the sketch of its union?  Exact if both sketches are whole sets."""
    both = F.array_intersect(a, b)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    hits = F.size(F.array_intersect(union, both))
    whole = (na < k) & (nb < k)
    exact = 100 * F.size(both) >= percent * F.size(F.array_union(a, b))
    return F.when(whole, exact).otherwise(hits >= least_matches(k, percent))


def _prefixes(reps: DataFrame, k: int, percent: int, long: int) -> DataFrame:
    """(rep, n, cold, hot): the values of each representative's prefix on ordinary and on long lists."""
    entries = reps.select("rep", F.explode("sketch").alias("v"))
    hot = entries.groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") > long).select("v")
    found = entries.join(hot, "v").groupBy("rep").agg(F.collect_list("v").alias("hv"))  # at most k of a text
    none = F.array().cast("array<bigint>")
    p = reps.select("rep", "n", "sketch").join(found, "rep", "left").withColumn("hv", F.sort_array(F.coalesce("hv", none)))
    p = p.withColumn("cold", F.array_except("sketch", "hv"))
    p = p.withColumn("len", F.size("sketch") - _need(F.col("n"), k, percent) + 1)
    # a text that gets here has over half of its values on long lists, so a similar text has each of these with a chance
    # of 0.73 at least: the pair misses all of them with 0.27^16 < 1e-9
    rest = F.greatest(F.lit(0), F.least(F.lit(LISTS), F.col("len") - F.size("cold")))
    return p.select("rep", "n", F.expr("slice(cold, 1, len)").alias("cold"), F.slice("hv", F.lit(1), rest).alias("hot"))


def _pairs_of_short_lists(pre: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared): pairs of texts on a list of at most LONG members, with sizes that allow the threshold."""
    lists = (pre.select("rep", "n", F.explode("cold").alias("v")).groupBy("v")
             .agg(F.sort_array(F.collect_list(F.struct("n", "rep"))).alias("l")).where(F.size("l") > 1))
    pairs = F.expr(f"""flatten(transform(l, (x, i) -> transform(
        filter(slice(l, i + 2, size(l)), y -> 100 * x.n >= {percent} * y.n and x.rep <> y.rep),
        y -> struct(least(x.rep, y.rep) as a, greatest(x.rep, y.rep) as b))))""")
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias(name))


def _estimate(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that their sketches admit."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    return p.where(admitted(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), k, percent)).drop("na", "nb", "sa", "sb")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(a, b) of the pairs whose full sets meet the threshold; the texts are read whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PAIRS) for b in batches for i in range(0, b.num_rows, PAIRS)):
            both = [[shingle_set(w.hash[w.row(r)], shingle) for w in words(batch.column(c), NON_SPACE) for r in range(w.hi - w.lo)]
                    for c in (2, 3)]
            ok = []
            for x, y in zip(*both):
                common = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(bool(len(x) and 100 * common >= percent * (len(x) + len(y) - common)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long")


def _with_component(df: DataFrame, comps: DataFrame, col: str, out: str) -> DataFrame:
    named = comps.select(F.col("u").alias(col), F.col("v").alias("_v"))
    return df.join(named, col, "left").withColumn(out, F.coalesce("_v", col)).drop("_v")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    return _with_component(_with_component(pairs, comps, "a", "_ca"), comps, "b", "_cb").where("_ca <> _cb").drop("_ca", "_cb")


def _leader_pairs(hot: DataFrame, seeds: range) -> DataFrame:
    """(a, b): every member of a long list with a leader of the list, one leader for each seed."""
    pick = [F.min_by("rep", F.xxhash64("rep", F.lit(s))).alias(f"l{s}") for s in seeds]
    leaders = hot.groupBy("v").agg(*pick).select("v", F.explode(F.array(*[F.col(f"l{s}") for s in seeds])).alias("leader"))
    p = hot.join(leaders, "v").where("rep <> leader")
    return p.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def _full_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(rep, set): all shingle hashes of a text, sorted, made like those of the sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), NON_SPACE):
                sets = [(shingle_set(w.hash[w.row(r)], shingle) >> np.uint64(1)).astype(np.int64) for r in range(w.hi - w.lo)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo),
                                                  pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["rep", "set"])
    return texts.select("doc_id", "text").mapInArrow(run, "rep long, set array<long>")


def _shared(values: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the arrays share; a bounded number of columns at a time."""
    n = len(values)
    row = np.repeat(np.arange(n), [len(x) for x in values])
    _, col, many = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    row, col = row[many[col] > 1], col[many[col] > 1]
    col = np.unique(col, return_inverse=True)[1]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(col.max(initial=-1)) + 1, 4096):
        part = (col >= lo) & (col < lo + 4096)
        m = np.zeros((n, 4096), np.float32)
        m[row[part], col[part] - lo] = 1
        out += m @ m.T
    return out


def _links_of_long_lists(hot: DataFrame, sets: DataFrame, comps: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between different components whose texts meet on a long list; enough to join what is linked.

    The largest component of a list is never compared with itself.  The others
    are dealt into blocks by a hash; a task compares two blocks: the sketches
    drop most pairs, a pair counts on its first common list only, and the full
    sets confirm the rest.  Only a link that joins something becomes a row.
    """
    h = _with_component(hot, comps, "rep", "comp")
    sizes = h.groupBy("v", "comp").agg(F.count("*").alias("c")).groupBy("v").agg(
        F.sum("c").alias("all"), F.count("*").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"))
    sizes = sizes.where("comps > 1").select("v", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("nr"),
                                            F.ceil(F.col("most") / BLOCK).cast("int").alias("nm"))
    h = h.join(sizes, "v").withColumn("rest", F.col("comp") != F.col("main"))
    h = h.withColumn("mine", F.pmod(F.xxhash64("rep"), F.when(F.col("rest"), F.col("nr")).otherwise(F.col("nm"))).cast("int"))
    to = F.expr("""case when rest then concat(
        transform(sequence(0, nr - 1), j -> struct(0 as kind, least(mine, j) as i, greatest(mine, j) as j)),
        transform(sequence(0, nm - 1), j -> struct(1 as kind, mine as i, j as j)))
        else transform(sequence(0, nr - 1), i -> struct(1 as kind, i as i, mine as j)) end""")
    dealt = h.select("v", "rep", "comp", "rest", F.explode(to).alias("t")).select("v", "t.kind", "t.i", "t.j", "rep", "comp", "rest")
    lists = hot.groupBy("rep").agg(F.collect_set("v").alias("on"))  # at most k
    dealt = dealt.join(sets.join(lists, "rep"), "rep")
    least = np.array([min(math.ceil(n * percent / 100), least_matches(k, percent)) for n in range(k + 1)])

    def compare(df):
        import pandas as pd
        full = [np.asarray(x) for x in df["set"]]
        n = np.array([len(x) for x in full])
        comp, rest, rep, v = df["comp"].to_numpy(), df["rest"].to_numpy(), df["rep"].to_numpy(), df["v"].iloc[0]
        need = least[np.minimum(n, k)]
        ok = np.triu(_shared([x[:k] for x in full]) >= np.maximum(need[:, None], need[None, :]), 1)
        ok &= (comp[:, None] != comp[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
        if df["kind"].iloc[0] == 1:
            ok &= rest[:, None] != rest[None, :]
        ok &= _shared([np.asarray([y for y in x if y < v], np.int64) for x in df["on"]]) == 0
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c
        a, b = [], []
        for x, y in zip(*np.nonzero(ok)):
            cx, cy = find(comp[x]), find(comp[y])
            if cx == cy:
                continue
            common = len(np.intersect1d(full[x], full[y], assume_unique=True))
            if 100 * common >= percent * (n[x] + n[y] - common):
                root[cx] = cy
                a.append(min(rep[x], rep[y]))
                b.append(max(rep[x], rep[y]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})
    return dealt.groupBy("v", "kind", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = K, shingle: int = SHINGLE, long: int = LONG) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Texts with 100 * intersection >= percent * union of their shingle sets are
    linked; component_id is the smallest doc_id reachable.  Null and empty
    texts are linked with nothing.  A null doc_id can't be linked: its row is
    kept with a null component.  Rows with one doc_id are one node; an empty
    table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    s = cut(sketches(docs, k, shingle))
    reps = cut(s.where("n > 0 and doc_id is not null").groupBy("digest")
               .agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")))
    classes = reps.select("digest", "rep")
    tidy(spark)
    pre = cut(_prefixes(reps, k, percent, long))
    tidy(spark)
    hot = cut(pre.select("rep", "n", F.explode("hot").alias("v")))
    near = cut(_pairs_of_short_lists(pre, percent))
    # from here on only sketches and texts that a pair needs are shuffled
    reps = cut(only(reps, _ends(near, "rep").unionByName(hot.select("rep")), "rep").drop("digest"))
    cold = cut(_estimate(near, reps, k, percent))
    wanted = _ends(cold, "doc_id").unionByName(hot.select(F.col("rep").alias("doc_id")))
    texts = (only(docs.select("doc_id", "text"), wanted, "doc_id")
             .groupBy("doc_id", F.xxhash64("text").alias("_h")).agg(F.any_value("text").alias("text")))
    texts = cut(texts.select("doc_id", "text"))
    tidy(spark)

    def linked(pairs: DataFrame) -> DataFrame:
        return _confirm(pairs, texts, percent, shingle)

    # 1: for each text its best partner with a smaller id, and the first leader of its long lists
    best = cold.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    lead = _estimate(_leader_pairs(hot, range(1)), reps, k, percent)
    comps = components(linked(best.unionByName(lead).distinct()))
    # 2: whatever pairs of short lists are still apart, and more leaders
    more = _estimate(_apart(_leader_pairs(hot, range(1, 3)), comps), reps, k, percent)
    rest = _apart(cold.select("a", "b"), comps).unionByName(more).distinct()
    stars = comps.select(F.col("v").alias("a"), F.col("u").alias("b"))
    comps = components(linked(rest).unionByName(stars))
    tidy(spark)
    # 3: what is still apart on long lists
    sets = _full_sets(texts.join(hot.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle)
    far = cut(_links_of_long_lists(hot, sets, comps, k, percent))
    if not far.isEmpty():
        stars = comps.select(F.col("v").alias("a"), F.col("u").alias("b"))
        comps = components(far.unionByName(stars))
    labels = _with_component(classes, comps, "rep", "component")
    # rows with one id and several sets are one node already; equal sets are one class
    out = s.select("doc_id", "n", "digest").join(labels.select("digest", "component"), "digest", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The documents that stay, columns unchanged: one of every group of near copies, the one with the smallest id.

    Where ids are missing or repeat, a document is an id and a text: different
    texts of one id are compared like any others, rows without an id are the last
    of their group, and of rows alike in both one stays.  Texts without words
    all stay.
    """
    ids = docs.groupBy("doc_id").count()
    if ids.where("doc_id is null or count > 1").isEmpty():
        gone = near_duplicates(docs, **params).where("not kept").select("doc_id")
        return docs.join(checked(gone), "doc_id", "left_anti").select(*docs.columns)
    rows = docs.select("doc_id", "text", text_key().alias("key"))
    numbers = rows.groupBy("doc_id", "key").agg(F.count("*").alias("copies")).withColumn("last", F.col("doc_id").isNull())
    numbers = cut(ranked(numbers, ["last", "doc_id", "key"]).select("doc_id", "key", "copies", F.col("before").alias("number")))
    same = F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.key") == F.col("n.key"))
    texts = rows.alias("d").join(numbers.alias("n"), same).select(F.col("n.number").alias("doc_id"), "d.text")
    # repeated rows give repeated rows here, with one answer
    found = near_duplicates(cut(texts), **params).select(F.col("doc_id").alias("number"), "n_shingles", "kept").distinct()
    found = cut(numbers.join(found, "number"))
    stay = without(docs, found.where("not kept"))
    again = found.where("kept and n_shingles > 0 and copies > 1")
    if again.isEmpty():
        return stay
    key = fresh(docs, "key")
    once = within(stay, again).withColumn(key, text_key()).dropDuplicates(["doc_id", key]).select(*docs.columns)
    return without(stay, again).unionByName(once)
