"""Random-projection node embeddings (Chen et al. 2019) and what is done with vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.edges import TRANSACTION
from kithgraph.operators.sampling import seeded_sample
from kithgraph.operators.skew import hot_rows
from kithgraph.session import cut_lineage, cut_placed, drop_cut, drop_path, drop_shuffles, scratch_path

DIM = 64
WEIGHTS = (0.0, 1.0, 1.0)
NORM_STRENGTH = -1.0
SEED = 42
BLOCK = 16  # coordinates per hash
HEX_DIGITS = 15  # 60 bits hold more than 16 base-6 digits


def start_vectors(degrees: DataFrame, dim: int, norm: float, seed: int) -> DataFrame:
    """`degrees` with `vec`: a sparse random vector per node, scaled by degree ** norm.

    Each block of coordinates reads the base-6 digits of one hash of the node id: 0 gives
    +sqrt(3), 1 gives -sqrt(3), the other four give 0.
    """
    blocks = -(-dim // BLOCK)

    def hashed(b: int) -> Column:
        text = F.concat(F.col("node_id"), F.lit(f"|{b}|{seed}"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("bigint")

    def block(b: int) -> str:
        powers = ", ".join(f"{6**i}L" for i in range(min(BLOCK, dim - b * BLOCK)))
        value = f"CASE (_h{b} div p) % 6 WHEN 0 THEN sqrt(3D) WHEN 1 THEN -sqrt(3D) ELSE 0D END"
        return f"transform(array({powers}), p -> cast({value} * _scale AS float))"

    drawn = degrees.select(
        "*", F.pow(F.col("n"), norm).alias("_scale"), *[hashed(b).alias(f"_h{b}") for b in range(blocks)]
    )
    return drawn.select(*degrees.columns, F.expr(f"concat({', '.join(map(block, range(blocks)))})").alias("vec"))


class _Placed(NamedTuple):
    """Undirected edges by the node that sends: one row per node, placed by its leader, sorted by leader and node id.

    The leader is the node with most neighbours among a node and its neighbours, so that a node
    mostly lies in the partition of those it hears. `home` has (leader, node_id, n, to_hot, close,
    far) of the nodes that are not hot: degree, codes of hot neighbours, ids of the others with the
    same leader, (leader, id) of the rest, parallel edges repeated. `hot` has (node_id, n, code) of
    the fewer than HOT_KEYS hot nodes, `among` (code, to, times) the edges between those.
    """

    home: DataFrame
    hot: DataFrame | None
    among: DataFrame | None
    parts: int


_KEY = ["leader", "node_id"]


def _freed(cut: Callable[[DataFrame], DataFrame], df: DataFrame, *unused: DataFrame) -> DataFrame:
    """`df` stored by `cut`; its shuffle files and the `unused` stored frames it was made from are deleted."""
    out = cut(df)
    drop_shuffles(df)
    for old in unused:
        drop_cut(old)
    return out


def _by_leader(home: DataFrame, parts: int) -> DataFrame:
    """`home` of (node_id, n, to_hot, near), placed by node id, as `_Placed` has it; deletes it."""
    size = F.size("near").alias("c")
    tell = home.select(F.explode(F.array_distinct("near")).alias("to"), F.struct(size, "node_id").alias("best"))
    heard = tell.repartition(parts, "to").groupBy("to").agg(F.max("best").alias("best"))
    leader = F.when(F.col("best") > F.struct(size, "node_id"), F.col("best.node_id")).otherwise(F.col("node_id"))
    led = home.join(heard, F.col("node_id") == F.col("to"), "left").select("node_id", "n", "to_hot", "near", leader.alias("leader"))
    led = _freed(cut_placed, led.sortWithinPartitions("node_id"), home)
    # A node's neighbours are those it is a neighbour of, as often.
    tell = led.select(F.explode("near").alias("to"), F.struct("leader", F.col("node_id").alias("id")).alias("from"))
    heard = tell.repartition(parts, "to").groupBy("to").agg(F.collect_list("from").alias("from"))
    known = led.join(heard, F.col("node_id") == F.col("to"), "left").select(
        *_KEY,
        "n",
        "to_hot",
        F.expr("transform(filter(from, f -> f.leader = leader), f -> f.id)").alias("close"),
        F.expr("filter(from, f -> f.leader <> leader)").alias("far"),
    )
    return _freed(cut_placed, known.repartition(parts, "leader").sortWithinPartitions(*_KEY), led)


def _placed(edges: DataFrame) -> _Placed:
    """Place the edges once for all steps; degrees do not change between them."""
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pair = F.array(
        F.struct(F.col("src").alias("node_id"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("node_id"), F.col("src").alias("dst")),
    )
    path = scratch_path(spark, "edges")  # columns of ids take a tenth of a checkpoint's space
    pairs = edges.select("src", "dst")
    pairs.write.parquet(path)
    undirected = spark.read.schema(pairs.schema).parquet(path).select(F.inline(pair))
    degrees = _freed(cut_lineage, undirected.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")))
    hot, among = hot_rows(degrees, "n"), None
    drop_cut(degrees)
    if hot is None:
        coded = undirected.withColumn("to", F.lit(None).cast("int"))
    else:
        rows = hot.toArrow()  # fewer than HOT_KEYS rows
        rows = rows.append_column("code", pa.array(range(rows.num_rows), pa.int32()))
        hot = spark.createDataFrame(rows)
        codes = hot.select("node_id", "code")
        coded = undirected.join(F.broadcast(codes), "node_id", "left").join(
            F.broadcast(codes.toDF("dst", "to")), "dst", "left"
        )
        among = coded.filter("code IS NOT NULL AND to IS NOT NULL").groupBy("code", "to").agg(F.count(F.lit(1)).alias("times"))
        among = _freed(cut_lineage, among)
        coded = coded.filter("code IS NULL")
    home = (
        coded.select("node_id", "dst", "to")
        .repartition(parts, "node_id")
        .groupBy("node_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.collect_list("to").alias("to_hot"),
            F.collect_list(F.when(F.col("to").isNull(), F.col("dst"))).alias("near"),
        )
        .sortWithinPartitions("node_id")
    )
    home = _freed(cut_placed, home)
    drop_path(spark, path)
    return _Placed(_by_leader(home, parts), hot, among, parts)


def _mean(vectors: DataFrame, key: Sequence[str], dim: int) -> DataFrame:
    """(*key, vec): mean of the vectors of a key as floats, each counted `times`, added up in doubles."""
    sums = vectors.groupBy(*key).agg(
        F.sum("times").alias("n"), *[F.expr(f"sum(cast(vec[{i}] AS double) * times) AS s{i}") for i in range(dim)]
    )
    items = ", ".join(f"cast(s{i} / n AS float)" for i in range(dim))
    return sums.select(*key, F.expr(f"array({items})").alias("vec"))


def _neighbour_mean(
    edges: _Placed, sent: DataFrame, few: DataFrame | None, dim: int, mark: str | None
) -> tuple[DataFrame, DataFrame | None]:
    """Mean of the neighbours' vectors per node, parallel edges counted each: (others, hot nodes).

    `sent` is `home` with the vectors of its nodes, `few` has (code, vec) of the hot nodes.
    Only vectors between two nodes that are not hot and have different leaders are shuffled, as
    they are: hot nodes' vectors are broadcast to their neighbours, where those are placed, and
    sums for hot nodes combine before the shuffle, one a task. `mark` limits the receiving nodes to those whose
    id starts with it.
    """
    once = F.lit(1).alias("times")
    close = sent.select("leader", F.explode("close").alias("node_id"), "vec")
    far = sent.select(F.explode("far").alias("f"), "vec").select("f.leader", F.col("f.id").alias("node_id"), "vec")
    to = edges.home.select(*_KEY, F.explode("to_hot").alias("code"))
    if mark is not None:
        close, far, to = (x.filter(F.col("node_id").startswith(mark)) for x in (close, far, to))
    messages = close.unionByName(far.repartition(edges.parts, "leader"))
    if edges.hot is None:
        return _mean(messages.select("*", once), _KEY, dim), None
    near = to.join(F.broadcast(few), "code").select(*_KEY, "vec")
    others = _mean(messages.unionByName(near).select("*", once), _KEY, dim)
    receivers = edges.hot if mark is None else edges.hot.filter(F.col("node_id").startswith(mark))
    own = sent.select(F.explode("to_hot").alias("code"), "vec", once)
    crowd = edges.among.join(F.broadcast(few), "code").select(F.col("to").alias("code"), "vec", "times")
    heard = own.unionByName(crowd).join(F.broadcast(receivers.select("code")), "code", "left_semi")
    return others, _mean(heard, ["code"], dim)


def _norm(vec: str) -> Column:
    return F.expr(f"sqrt(aggregate({vec}, 0D, (sum, x) -> sum + cast(x AS double) * x))")


def fastrp(
    edges: DataFrame,
    nodes: DataFrame,
    dim: int = DIM,
    weights: Sequence[float] = WEIGHTS,
    norm: float = NORM_STRENGTH,
    seed: int = SEED,
    node_type: str = TRANSACTION,
) -> DataFrame:
    """(node_id, embedding) of the nodes of one type; labels are not used.

    Weight k applies to the normalised neighbour mean after k+1 steps. The start vectors
    depend on node id and seed only, so a rerun gives the same result whatever the
    partitioning. Nodes without edges get the zero vector.
    """
    placed = _placed(edges)
    home, hot = placed.home, placed.hot
    sent = start_vectors(home, dim, norm, seed)
    few = None if hot is None else cut_lineage(start_vectors(hot, dim, norm, seed).select("code", "vec"))
    mark = f"{node_type}:"
    chosen = F.col("node_id").startswith(mark)
    own = home.filter(chosen).select(*_KEY)
    ids = own.select("node_id")
    own_hot = None if hot is None else hot.filter(chosen).select("node_id", "code")
    if own_hot is not None:
        ids = ids.unionByName(own_hot.select("node_id"))
        own_hot = None if own_hot.isEmpty() else own_hot
    terms, read, unused = [], [], ()  # `unused`: stored vectors that only the next step reads
    last = max((k for k, w in enumerate(weights) if w), default=-1)
    for k, weight in enumerate(weights[: last + 1]):
        vectors, few = _neighbour_mean(placed, sent, few, dim, None if k < last else mark)
        few = None if few is None or (k == last and own_hot is None) else _freed(cut_placed, few)
        if k < last:  # the last ones are joined below, where they are made
            vectors = _freed(cut_placed, vectors.sortWithinPartitions(*_KEY), *unused)
            sent, unused = home.join(vectors, _KEY), () if weight else (vectors,)
            read += [vectors] if weight else []
        if weight:
            terms.append(k)
            named = [F.col("vec").alias(f"_v{k}"), (F.lit(float(weight)) / F.nullif(_norm("vec"), F.lit(0.0))).alias(f"_w{k}")]
            # A node with edges receives in every step, and both sides are placed alike.
            own = own.join(vectors.select(*_KEY, *named), _KEY)
            own_hot = None if own_hot is None else own_hot.join(F.broadcast(few.select("code", *named)), "code")
    total = f"array_repeat(0D, {dim})"
    for k in terms:  # a vector of zeros has no norm and adds nothing
        total = f"zip_with({total}, _v{k}, (t, x) -> t + coalesce(cast(x AS double) * _w{k}, 0D))"
    embedding = F.expr(f"transform({total}, t -> cast(t AS float))").alias("embedding")
    own = _freed(cut_placed, own.select("node_id", embedding), *unused, *read)
    if own_hot is not None:
        own = own.unionByName(own_hot.select("node_id", embedding))
    listed = nodes.filter(F.col("node_type") == node_type).select("node_id").distinct()
    nothing = F.array_repeat(F.lit(0.0).cast("float"), dim).alias("embedding")
    # Vectors stay where they are: only ids meet to find the nodes without edges.
    return own.unionByName(listed.join(ids, "node_id", "left_anti").select("node_id", nothing))


def transaction_embeddings(embedding: DataFrame) -> DataFrame:
    """(transactionId, embedding) from transaction node ids."""
    key = F.substring("node_id", len(TRANSACTION) + 2, 40).cast("bigint")
    return embedding.select(key.alias("transactionId"), "embedding")


def expand_embedding(emb: DataFrame, dim: int = DIM, prefix: str = "emb_") -> DataFrame:
    """The vector as one float column per coordinate."""
    return emb.select(
        "transactionId", *[F.col("embedding")[i].cast("float").alias(f"{prefix}{i}") for i in range(dim)]
    )


def covariance(emb: DataFrame, dim: int = DIM) -> DataFrame:
    """(i, j, n, cov) for i <= j: population covariances of the coordinates over all vectors.

    Products are taken of centred coordinates, so they lose no digits to the mean, and each
    task adds up its own, so dim x dim sums leave it, however many vectors it read. Null
    vectors, those with a null and those of another length do not count; without any there are no rows.
    """
    whole = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull())
    rows = emb.filter(whole).select("embedding")
    # One row of `dim` means; without vectors they are null and nothing is centred.
    means = rows.agg(*[F.avg(F.col("embedding")[k].cast("double")) for k in range(dim)]).first()
    centre = np.array([m or 0.0 for m in means])
    i, j = np.triu_indices(dim)

    def run(batches):
        n, total = 0, np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = x.astype(np.float64) - centre
                n, total = n + len(x), total + x.T @ x
        if n:
            counts = np.full(len(i), n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, j, counts, total[i, j])], ["i", "j", "n", "s"])

    sums = rows.mapInArrow(run, "i long, j long, n long, s double")
    return sums.groupBy("i", "j").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("cov"))


def pca_2d(emb: DataFrame, n: int = 10_000, seed: int = SEED) -> DataFrame:
    """Two principal components of a repeatable sample, centred, with their variance shares.

    The covariance is summed in the executors; the driver solves one dim x dim problem.
    The sign is chosen so that the largest loading of each component is positive.
    """
    sample = seeded_sample(emb, "transactionId", n, seed)
    sample = cut_lineage(sample.select("transactionId", array_to_vector("embedding").alias("features")))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(sample)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    shares = [float(x) for x in model.explainedVariance]
    mean = sample.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    shift = [float(mean @ loadings[:, j]) for j in range(2)]
    pc = vector_to_array("pc")
    return model.transform(sample).select(
        "transactionId",
        *[((pc[j] - F.lit(shift[j])) * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(2)],
        *[F.lit(shares[j]).alias(f"pc{j + 1}_variance") for j in range(2)],
    )
