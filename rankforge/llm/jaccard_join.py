"""N-gram Jaccard join (op 7): blocks of a sparse document by n-gram product.

A document's set is its distinct ``n``-word shingles; equal sets are one vertex. Two sets link when
``100 * intersection >= percent * union``.

1. A page exchange tells how many vertices hold each shingle (a document frequency that may only be too high, and is
   the same for all holders of a shingle, so the order it gives is one order for all).
2. Of ``s`` shingles, a link needs ``ceil(percent * s / 100)`` in common, so its rarest ``s - that + 1`` shingles hold a
   common one: the size-derived bound. Where all of these are unique, nothing can link; most documents end here,
   however many share a passage with them. The others carry these keys, and their shingles that are not unique.
3. Vertices are grouped by connection over keys. Small groups are packed into blocks of the product. Large groups are cut
   into bands of sizes, of which only neighbouring ones can link, and bands into tiles; a block is a pair of tiles.
   First each tile meets itself and the first tile of its band and of the next, which joins what is alike throughout,
   in as many blocks as there are tiles. Then only vertices with a key that is held in two components still apart meet,
   in blocks of tiles that share such a key.
4. In a block overlaps add up from inverted lists, pairs below the bound are discarded, and the block returns a
   spanning forest of its links, never all pairs. Components of the forests' edges give that of each document.

Cases. Null texts and texts without words have an empty set and link with nothing; fewer words than ``n`` are one
shingle. Rows of equal id are documents of their own; a component's id is its smallest non-null id. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pages as P
from .common import SPACE, Words, documents, materialize, mix, one_row_each, skew_join
from .components import connected

N, PERCENT, TILE = 4, 85, 512
SETS = "doc_id long, n_shingles long, vertex binary, rare array<bigint>, shared binary, md5 string"


class Sets:
    """Distinct shingles of the distinct sets of a page. Set i has shingles off[i]:off[i + 1], of document first[i]."""

    def __init__(self, text: pa.Array, n: int):
        words = Words(text, lower=True)
        starts, h = words.windows(n)
        doc = np.searchsorted(words.off, starts, "right") - 1
        few = np.flatnonzero((words.n > 0) & (words.n < n))
        if len(few):
            extra = [mix(np.array([np.bitwise_xor.reduce(mix(words.hash[words.off[d] : words.off[d + 1]] + np.arange(words.n[d], dtype=np.uint64)))], np.uint64) + words.n[d].astype(np.uint64))[0] for d in few]
            doc, h = np.concatenate([doc, few]), np.concatenate([h, np.array(extra, np.uint64)])
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        doc, h = doc[order], h[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[keep], h[keep]
        docs = len(words.n)
        off = np.searchsorted(doc, np.arange(docs + 1))
        self.size = np.diff(off)
        #: of each document, two independent hashes of its set: sets that agree in both are taken as equal (n * n / 2**129 pairs expected)
        self.vertex = np.empty((docs, 2), "<u8")
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(h ^ np.uint64(salt)) + np.uint64(salt >> k)), dtype=np.uint64)])
            self.vertex[:, k] = mix(sums[off[1:]] - sums[off[:-1]] + self.size.astype(np.uint64))
        full = np.flatnonzero(self.size)
        order = full[np.lexsort((full, self.vertex[full, 1], self.vertex[full, 0]))]
        new = np.concatenate([np.ones(min(1, len(order)), bool), (self.vertex[order[1:]] != self.vertex[order[:-1]]).any(axis=1)])
        self.first = np.sort(order[new])
        chosen = np.zeros(docs, bool)
        chosen[self.first] = True
        self.hash = h[chosen[doc]]
        self.off = np.concatenate([[0], np.cumsum(self.size[self.first])])


def _keys(s: Sets):
    return np.unique(s.hash, return_inverse=True, return_counts=True)


def _ask(n: int, buckets: int):
    # 32 bits of what a key has over its bucket's first: a clash makes a shingle look less rare, for all its holders
    shift = np.uint64(max(0, 32 - int(math.log2(buckets))))

    def f(table: pa.Table) -> pa.Table:
        own, _, count = _keys(Sets(P.load(table)[1], n))
        page, count = table.column("page")[0].as_py(), np.minimum(count, 255).astype(np.uint8)
        rows = []
        for b, x, y in P.slices(P.bucket_of(own, buckets)):
            low = np.uint64(((b << 32) + buckets - 1) // buckets << 32)
            rows.append((page, b, P.squeeze(P.steps(((own[x:y] - low) >> shift).astype("<u4")) + count[x:y].tobytes())))
        return P.pack(rows)

    return f


def _answer(table: pa.Table) -> pa.Table:
    pages, raw = zip(*P.asked(table), strict=True)
    sizes = [len(b) // 5 for b in raw]
    key = np.concatenate([P.unsteps(b[: 4 * n], "<u4") for b, n in zip(raw, sizes, strict=True)])
    count = np.concatenate([np.frombuffer(b, np.uint8, n, 4 * n) for b, n in zip(raw, sizes, strict=True)])
    _, which = np.unique(key, return_inverse=True)
    df = np.bincount(which, weights=count)
    # exact below 128, then eight steps for each doubling
    code = np.where(df < 128, df, np.minimum(255, 128 + 8 * np.log2(np.maximum(df, 128) / 128))).astype(np.uint8)[which]
    at, bucket = np.cumsum([0, *sizes]), table.column("bucket")[0].as_py()
    return P.pack([(p, bucket, P.squeeze(code[x:y].tobytes())) for p, x, y in zip(pages, at[:-1], at[1:], strict=True)])


def _sets(n: int, percent: int, buckets: int, digest: bool):
    def f(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, text = P.load(table)
        s = Sets(text, n)
        own, which, _ = _keys(s)
        code = P.in_order(P.bucket_of(own, buckets), replies, np.uint8)[which]
        rare: list = [None] * len(ids)
        shared: list = [None] * len(ids)
        size = np.diff(s.off)
        need = -(-percent * size // 100)
        for i in np.flatnonzero(np.add.reduceat(np.append(code > 1, False), s.off[:-1]) >= need) if len(size) else ():
            c, h = code[s.off[i] : s.off[i + 1]], s.hash[s.off[i] : s.off[i + 1]]
            order = np.lexsort((h, c))[: size[i] - need[i] + 1]
            rare[s.first[i]] = h[order[c[order] > 1]].view(np.int64)
            shared[s.first[i]] = h[c > 1].tobytes()
        vertex = [v.tobytes() if k else None for v, k in zip(s.vertex, s.size, strict=True)]
        md5 = [hashlib.md5(t).hexdigest() for t in text.to_pylist()] if digest else [None] * len(ids)
        return pa.table({
            "doc_id": ids, "n_shingles": s.size.astype(np.int64), "vertex": pa.array(vertex, pa.binary()),
            "rare": pa.array(rare, pa.list_(pa.int64())), "shared": pa.array(shared, pa.binary()), "md5": pa.array(md5, pa.string()),
        })

    return f


def overlaps(row: np.ndarray, shingle: np.ndarray, m: int) -> np.ndarray:
    """m x m counts of common shingles, upper triangle; row, shingle: the entries of a 0/1 matrix."""
    order = np.lexsort((row, shingle))
    row, shingle = row[order], shingle[order]
    head = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(row) else np.empty(0, int)
    length = np.diff(np.append(head, len(row)))
    out = np.zeros(m * m, np.int64)
    for n in np.unique(length[length > 1]):
        at = head[length == n]
        if n <= 48:
            i, j = np.triu_indices(n, 1)
            for a in range(0, len(at), max(1, (1 << 20) // len(i))):
                rows = row[at[a : a + max(1, (1 << 20) // len(i)), None] + np.arange(n)]
                out += np.bincount((rows[:, i] * m + rows[:, j]).ravel(), minlength=m * m)
        else:
            full = out.reshape(m, m)
            for a in at:
                own = row[a : a + n]
                full[np.ix_(own, own)] += 1
    return np.triu(out.reshape(m, m), 1)


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    m, out = len(link), []
    left = np.ones(m, bool)
    for start in range(m):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(link[i] & left)
            left[found] = False
            out += [(i, int(j)) for j in found]
            todo += found.tolist()
    return out


def _block(percent: int):
    def f(table: pa.Table) -> pa.Table:
        raw = table.column("vertex").to_pylist()
        at = {v: i for i, v in enumerate(raw)}  # a vertex once, whatever rows there are
        table, vertex = table.take(pa.array(list(at.values()), pa.int64())), list(at)
        side, size = table.column("side").to_numpy(), table.column("n_shingles").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shared").to_pylist()]
        m = len(vertex)
        both = overlaps(np.repeat(np.arange(m), [len(x) for x in sets]), np.concatenate(sets), m)
        link = (both > 0) & (100 * both >= percent * (size[:, None] + size[None, :] - both))
        if side.any():
            link &= side[:, None] != side[None, :]
        edges = forest(link | link.T)
        return pa.table({"a": pa.array([vertex[i] for i, _ in edges], pa.binary()), "b": pa.array([vertex[j] for _, j in edges], pa.binary())})

    return f


#: Tiles of a band have numbers from band * BAND on.
BAND = 1 << 40


def links(sets: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """a, b: spanning forests of the links between vertices, block by block."""
    # a vertex has a row for each page that holds it; blocks take it once
    held = sets.filter("shared is not null").select("vertex", "n_shingles", "shared", "rare")
    by_key = materialize(held.select("vertex", F.explode("rare").alias("k")).distinct())
    centre = by_key.groupBy("k").agg(F.min("vertex").alias("c"), F.count("*").alias("n")).filter("n > 1").drop("n")
    group = materialize(connected(skew_join(by_key, centre, ("k",)).select(F.col("vertex").alias("a"), F.col("c").alias("b"))))
    member = group.unionByName(group.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "vertex")
    size = group.groupBy("root").agg((F.count("*") + 1).alias("m"))
    rows = materialize(skew_join(member, size, ("root",)).join(held.drop("rare"), "vertex"))
    product = lambda blocks: blocks.select("g", "i", "j", "vertex", "n_shingles", "shared", "side").groupBy("g", "i", "j").applyInArrow(_block(percent), "a binary, b binary")
    small, large = rows.filter(F.col("m") <= tile), rows.filter(F.col("m") > tile)
    packs = F.lit(max(1, -(-small.count() // max(1, tile // 2))))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("binary")
    found = product(small.withColumns({"g": none, "i": F.pmod(F.xxhash64("root"), packs), "j": zero, "side": F.lit(0)}))
    if large.isEmpty():
        return found
    # bands: sizes of linked sets differ by a factor of 100 / percent at most, so by one band
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / min(percent, 99)) + 1e-9).cast("long") if percent < 100 else F.col("n_shingles")
    large = large.withColumn("band", band)
    bands = large.groupBy("root", "band").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    below = bands.select("root", (F.col("band") + 1).alias("band"), F.col("tiles").alias("tiles_below"))
    bands = bands.join(below, ["root", "band"], "left").withColumn("tiles_below", F.coalesce("tiles_below", F.lit(0)))
    large = skew_join(large, bands, ("root", "band")).withColumn("t", F.pmod(F.xxhash64("vertex"), F.col("tiles"))).withColumn("tile", F.col("band") * BAND + F.col("t"))
    large = materialize(large)

    def block(i, j, side: int):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    own, first, up = F.col("tile"), F.col("band") * BAND, (F.col("band") + 1) * BAND
    down = (F.col("band") - 1) * BAND
    until = lambda a, n: F.when(n > a, F.sequence(F.lit(a).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    meets = F.concat(
        F.array(block(own, own, 0), block(own, up, 0)),
        F.when(F.col("t") > 0, F.array(block(first, own, 1))).otherwise(F.transform(until(1, F.col("tiles")), lambda o: block(own, first + o, 0))),
        F.when(F.col("t") == 0, F.transform(until(0, F.col("tiles_below")), lambda o: block(down + o, own, 1))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,side:int>>")),
    )
    spine = materialize(product(large.withColumn("b", F.explode(meets)).select(F.col("root").alias("g"), "b.i", "b.j", "b.side", "vertex", "n_shingles", "shared")))
    # what is still apart though it shares a key
    part = connected(spine).withColumnsRenamed({"node": "vertex", "root": "part"})
    keyed = materialize(by_key.join(large.select("vertex", "root", "band", "t", "tile"), "vertex").join(part, "vertex", "left").withColumn("part", F.coalesce("part", "vertex")))
    apart = keyed.groupBy("k").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("k")
    keyed = materialize(skew_join(keyed, apart, ("k",)))
    # pairs of tiles, from the distinct sets of tiles that hold a key
    together = keyed.groupBy("root", "k").agg(F.sort_array(F.collect_set("tile")).alias("s")).select("root", "s").distinct()
    pairs = together.select("root", F.explode("s").alias("i"), "s").select("root", "i", F.explode(F.filter("s", lambda o: (o > F.col("i")) & (o < (F.floor(F.col("i") / BAND) + 2) * BAND))).alias("j")).distinct()
    band_of, t_of = (lambda c: F.floor(F.col(c) / BAND)), (lambda c: F.col(c) % BAND)
    met = F.when(band_of("i") == band_of("j"), t_of("i") == 0).otherwise(t_of("j") == 0)
    pairs = pairs.filter(~met)
    sides = pairs.select("root", F.col("i").alias("tile"), "i", "j", F.lit(0).alias("side")).unionByName(pairs.select("root", F.col("j").alias("tile"), "i", "j", F.lit(1).alias("side")))
    again = keyed.select("vertex", "root", "tile").distinct().join(sides, ["root", "tile"]).join(large.select("vertex", "n_shingles", "shared"), "vertex").withColumn("g", F.col("root"))
    return found.unionByName(spine).unionByName(product(again))


def _with_components(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, tile: int, digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, root (the component's name; null without words), md5 of the text (if asked for)."""
    plan = P.Plan(docs, text_col)
    pages = P.paged(docs, plan, id_col, text_col)
    replies = P.answer(P.ask(pages, _ask(n, plan.buckets)), _answer)
    sets = materialize(P.with_replies(pages, replies, _sets(n, percent, plan.buckets, digest), SETS))
    roots = connected(links(sets, percent, tile)).withColumnRenamed("node", "vertex")
    # a set's rows are aggregated before they are shuffled; only sets with several rows or links go on
    least = sets.filter("vertex is not null").groupBy("vertex").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    rooted = materialize(least.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("all")).filter("all > 1").drop("all")
    several = skew_join(rooted.select("vertex", "root"), smallest, ("root",))
    full = skew_join(sets.drop("rare", "shared"), several, ("vertex",), "left")
    return full.withColumns({"component_id": F.coalesce("component_id", F.when(F.col("root").isNull(), F.col("doc_id"))), "root": F.coalesce("root", "vertex")})


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links, its own included."""
    return _with_components(docs, id_col, text_col, n, percent, tile).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """One row of docs for each component: that of the smallest id (null last), then of the smallest md5 of the text.

    Rows without words link with nothing and stay. Rows alike in id and text are one document.
    """
    full = _with_components(docs, id_col, text_col, n, percent, tile, digest=True)
    alike = full.groupBy("root", "doc_id", "md5").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "md5", "n"))
    kept = alike.filter("root IS NOT NULL").groupBy("root").agg(first.alias("r")).select("r.doc_id", "r.md5", "r.n")
    return one_row_each(docs, kept.unionByName(alike.filter("root IS NULL").drop("root")), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))


#: The same by all pairs that share a shingle, and by following links.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) q ON q.doc_id = d.doc_id
"""
