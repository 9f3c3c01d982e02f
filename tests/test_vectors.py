"""Encoding, pooling, clustering, neighbours and pictures."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan
from corpusloom.functions import vectors as V
from corpusloom.operators import clusters, dense, keys, neighbours, projection, raster, spaces
from corpusloom.options import Options


@pytest.fixture(scope="module")
def emb(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # copies of one vector are a third of all
    return spark.createDataFrame(rows, "article_id bigint, embedding array<double>")


def test_encoder_and_pooling_agree(spark):
    rows = [(1, "One two. Three!", "four\nfive"), (2, "x", None), (3, None, "y")]
    articles = spark.createDataFrame(rows, "id bigint, title string, abstract string")
    opts = Options(exclude_missing_abstract=False, exclude_missing_title=True)
    found = {r.article_id: r.embedding for r in dense.encode_articles(articles, dense.hash_encoder(4), opts).collect()}
    assert set(found) == {1, 2}
    encode = dense.hash_encoder(4)()
    vectors, mask = encode(["One two.", "Three!", "four five"])
    rows = [
        (1, s, p, int(mask[s, p]), vectors[s, p].tolist()) for s in range(3) for p in range(mask.shape[1])
    ]
    table = spark.createDataFrame(rows, "article_id bigint, sent int, pos int, mask int, vec array<double>")
    want = dense.pool_articles(dense.pool_sentences(table)).first()
    # title and abstract are joined by a space, so "Three!" ends a sentence
    assert found[1] == pytest.approx(want.embedding)
    with pytest.raises(ValueError):
        dense.encode_articles(articles.filter("id > 9"), dense.hash_encoder(4))


def test_unmasked_sentence_is_zero(spark):
    table = spark.createDataFrame([(1, 0, 0, 0, [1.0, 2.0])], "article_id int, sent int, pos int, mask int, vec array<double>")
    assert dense.pool_sentences(table).first().embedding == [0.0, 0.0]


def test_keep_last_and_reports(spark):
    a = spark.createDataFrame([("1", [1.0]), ("2", [2.0])], "article_id string, embedding array<double>")
    b = spark.createDataFrame([("1", [9.0])], "article_id string, embedding array<double>")
    found = {r.article_id: r.embedding for r in dense.combine_embeddings(a, b, id_type="bigint").collect()}
    assert found == {1: [9.0], 2: [2.0]}
    assert tuple(keys.duplicate_report(a.union(b)).first()) == (3, 2)
    with pytest.raises(ValueError):
        keys.require_unique(a.union(b))


def test_wide_round_trip(emb):
    wide = V.to_wide(emb, 6)
    assert wide.columns == ["article_id", *(f"dim_{i}" for i in range(6))]
    assert V.from_wide(wide).exceptAll(emb).isEmpty()


def test_clusters(emb):
    found = clusters.cluster_articles(emb, 4, seed=1)
    assert found.count() == emb.count() == found.select("article_id").distinct().count()
    assert {r.cluster for r in found.select("cluster").distinct().collect()} <= {f"cluster_{i}" for i in range(4)}
    joined = emb.join(found, "article_id")
    centres = clusters.centroids(joined)
    assigned = clusters.assign_clusters(emb, centres)
    x = {r.article_id: np.array(r.embedding) for r in emb.collect()}
    c = {r.cluster: np.array(r.centroid) for r in centres.collect()}
    for row in assigned.collect():
        best = min(c, key=lambda k: (round(np.linalg.norm(x[row.article_id] - c[k]), 9), k))
        assert row.cluster == best


@pytest.mark.parametrize("metric", ["cosine", "jaccard"])
@pytest.mark.parametrize("block_rows", [17, 8192])
def test_neighbours_equal_brute_force(emb, metric, block_rows, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 40 if block_rows == 17 else 16_384)
    rows = {r.article_id: np.array(r.embedding) for r in emb.collect()}

    def distance(a, b):
        if metric == "cosine":
            return round(max(0.0, 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
        either = ((a > 0) | (b > 0)).sum()
        return round(1 - (((a > 0) & (b > 0)).sum() / either if either else 0), 9)

    found = {}
    for r in neighbours.knn_graph(emb, 4, metric, block_rows).orderBy("article_id", "rank").collect():
        found.setdefault(r.article_id, []).append((r.distance, r.neighbour))
    for i, a in rows.items():
        want = sorted((distance(a, b), j) for j, b in rows.items() if j != i)[:4]
        assert found[i] == want


def test_many_centroids_are_met_in_blocks(spark, emb, monkeypatch):
    random = np.random.default_rng(9)
    centres = [(f"c{k:04}", random.normal(size=6).tolist()) for k in range(700)]
    centres += [("a-copy", centres[5][1]), ("z-copy", centres[6][1])]
    table = spark.createDataFrame(centres, "cluster string, centroid array<double>")
    want = {r.article_id: r.cluster for r in clusters.assign_clusters(emb, table).collect()}
    monkeypatch.setattr(clusters, "TRAVELLING_CELLS", 100)
    monkeypatch.setattr(clusters, "BLOCK_CELLS", 6 * 64)
    blocks = clusters.assign_clusters(emb, table)
    assert {r.article_id: r.cluster for r in blocks.collect()} == want and len(want) == emb.count()


def listed(graph):
    found = {}
    for r in graph.orderBy("article_id", "rank").collect():
        found.setdefault(r.article_id, []).append((r.distance, r.neighbour))
    return found


def test_few_cells_are_visited_when_vectors_cluster(spark, monkeypatch):
    random = np.random.default_rng(4)
    centres = random.normal(size=(30, 8)) * 20
    x = np.concatenate([centres[np.arange(1500) % 30] + random.normal(size=(1500, 8)), np.zeros((2, 8))])
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "article_id bigint, embedding array<double>")
    made = {}
    keep = neighbours.staged

    def noted(df, name):
        made[name] = keep(df, name)
        return made[name]

    monkeypatch.setattr(neighbours, "staged", noted)
    found = listed(neighbours.knn_graph(emb, 5, cell_rows=30))
    norms = np.linalg.norm(x, axis=1)
    for i in range(0, 1502, 7):
        cos = np.divide(x @ x[i], norms * norms[i], out=np.zeros(len(x)), where=norms * norms[i] > 0)
        d = np.maximum((1 - cos).round(9), 0)
        assert found[i] == sorted((d[j], j) for j in range(len(x)) if j != i)[:5]
    first = made["neighbours-within"]
    cells = first.select("cell").distinct().count()
    visited = first.agg(F.avg(F.size("visits"))).first()[0]
    assert cells >= 25 and visited < 0.25 * cells


def term_sets(seed, n):
    """Articles of some topics, copies, subsets, and articles without terms."""
    random = np.random.default_rng(seed)
    sets = [set(random.zipf(1.5, size=random.integers(1, 40)).clip(max=50).tolist()) | {int(1000 * (i % 9) + t) for t in random.integers(0, 30, size=12)} for i in range(n)]
    sets += [sets[3]] * 40 + [set(list(sets[4])[:k]) for k in range(1, 10)] + [set(), set()]
    return {i: s for i, s in enumerate(sets)}


@pytest.mark.parametrize("metric", ["cosine", "jaccard"])
@pytest.mark.parametrize(("block_rows", "cell_rows"), [(4096, 512), (23, 10)])
def test_term_neighbours_equal_brute_force(spark, metric, block_rows, cell_rows):
    sets = term_sets(1, 150)
    weight = {t: 1 + 7.0 / (1 + t % 50) for s in sets.values() for t in s}
    rows = [(i, f"t{t}", weight[t] * (1 + i % 3 + t % 2)) for i, s in sets.items() for t in s]
    weights = spark.createDataFrame(rows, "id bigint, token string, weight double")
    articles = spark.createDataFrame([(i,) for i in sets], "id bigint")
    found = listed(neighbours.term_neighbours(weights, articles, 4, metric, block_rows, cell_rows))
    vectors = {i: {t: weight[t] * (1 + i % 3 + t % 2) for t in s} for i, s in sets.items()}

    def distance(i, j):
        a, b = vectors[i], vectors[j]
        if metric == "jaccard":
            either = len(a.keys() | b.keys())
            return round(1 - (len(a.keys() & b.keys()) / either if either else 0), 9)
        scale = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return max(0.0, round(1 - (sum(v * b.get(t, 0) for t, v in a.items()) / scale if scale else 0), 9))

    for i in sets:
        want = sorted((distance(i, j), j) for j in sets if j != i)[:4]
        assert [j for _, j in found[i]] == [j for _, j in want] and [d for d, _ in found[i]] == pytest.approx([d for d, _ in want], abs=2e-9)


@pytest.mark.parametrize("metric", ["cosine", "jaccard"])
def test_lists_stop_before_most_pairs_are_compared(metric):
    """Two blocks whose articles have near ones, besides terms that most articles share."""
    random = np.random.default_rng(6)
    sizes, codes = [], []
    for i in range(600):
        own = np.unique(np.concatenate([random.integers(60 * (i % 60), 60 * (i % 60) + 60, size=60), 4000 + random.integers(0, 40, size=30)]))
        sizes.append(len(own))
        codes.append(own)
    codes = np.concatenate(codes)
    weights = np.where(codes < 4000, 5.0, 1.0) if metric == "cosine" else np.ones(len(codes))
    terms = spaces.Terms(np.concatenate([[0], np.cumsum(sizes)]), codes, weights)
    if metric == "cosine":
        terms = spaces.Terms(terms.offsets, codes, weights / np.sqrt(terms.total(weights**2))[terms.rows])
    space = spaces.TermSpace(metric)
    a, b, d = space.best(terms, terms, 5, np.full(600, spaces.FAR), np.arange(600))
    every = space.distances(terms, terms)
    np.fill_diagonal(every, np.inf)
    r, c = spaces.nearest(every, 5)
    assert (a == r).all() and (b == c).all() and (d == every[r, c]).all()
    finished, pairs = space.counted
    assert pairs == 600 * 600 and finished < 0.1 * pairs


def test_neighbour_weights(emb):
    graph = neighbours.knn_graph(emb.filter("article_id < 200"), 5)
    found = neighbours.neighbor_weights(graph).collect()
    edges = {(r.article_id, r.neighbour) for r in graph.collect()}
    assert {(r.article1, r.article2) for r in found} == {tuple(sorted(e)) for e in edges}
    assert all(0 < r.weight <= 1 and r.article1 < r.article2 for r in found)
    near = [r.distance for r in graph.filter("article_id = 3").collect()]
    rho, low, high = min(near), 1e-9, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(math.exp(-(d - rho) / mid) for d in near) > math.log2(5) else (mid, high)
    one_way = next((r for r in graph.filter("article_id = 3").collect() if (r.neighbour, 3) not in edges), None)
    if one_way is not None:
        weight = next(r.weight for r in found if {r.article1, r.article2} == {3, one_way.neighbour})
        assert weight == pytest.approx(math.exp(-(one_way.distance - rho) / mid), abs=1e-6)


def test_projection(emb):
    flat = emb.limit(1).select(F.lit(999).cast("bigint").alias("article_id"), F.lit([1.0] * 6).alias("embedding"))
    found = projection.project_2d(emb.union(flat))
    assert found.count() == emb.count()
    mean = found.agg(F.avg("x1").alias("a"), F.avg("x2").alias("b"), F.var_pop("x1").alias("v"), F.var_pop("x2").alias("w")).first()
    assert abs(mean.a) < 1e-9 and abs(mean.b) < 1e-9 and mean.v >= mean.w
    assert projection.constant_vector_report(emb.union(flat)).first().n_constant == 1


def test_pixels_and_edges(spark):
    rows = [(i, float(i), float(10 - i)) for i in range(11)]
    points = spark.createDataFrame(rows, "article_id bigint, x1 double, x2 double")
    groups = points.select("article_id", F.when(F.col("x1") < 5, "cluster_0").otherwise("cluster_1").alias("cluster"))
    bounds = raster.clip_bounds(points, 1.0)
    pixels = raster.bin_points(raster.with_cluster(points, groups), 5, 5, bounds)
    assert pixels.agg(F.sum("n")).first()[0] == 11
    # (9, 1) and (10, 0): the point on the right edge belongs to the last pixel; (8, 2) is one pixel up
    assert pixels.filter("px = 4 and py = 0").first().n == 2
    with pytest.raises(Exception, match="no cluster for article"):
        raster.with_cluster(points, groups.filter("article_id > 3")).collect()
    many = spark.range(21).select(F.concat(F.lit("c"), "id").alias("cluster"))
    with pytest.raises(Exception, match="limited to 20 clusters"):
        raster.palette(many).collect()
    assert raster.palette(many.filter("cluster < 'c2'")).count() == 12
    picture = raster.visualize_embeddings(points, groups, Options(raster_width=5, raster_height=5)).collect()
    assert all(0 < r.alpha <= 1 for r in picture)


def test_single_point_picture(spark):
    points = spark.createDataFrame([(1, 2.0, 3.0)], "article_id bigint, x1 double, x2 double")
    groups = spark.createDataFrame([(1, "cluster_0")], "article_id bigint, cluster string")
    row = raster.visualize_embeddings(points, groups, Options(raster_width=5, raster_height=5)).first()
    assert (row.px, row.py, row.alpha) == (0, 0, 1.0)


def test_blocks_meet_without_a_shuffle(spark):
    """What is shuffled does not grow with the number of cells that are visited."""
    random = np.random.default_rng(11)
    x = random.normal(size=(300, 6))
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "article_id bigint, embedding array<double>")
    graph = neighbours.knn_graph(emb, 3, block_rows=20, cell_rows=20)
    text = plan(graph)
    assert "CartesianProduct" in text and "FlatMapGroupsInArrow" not in text
    likeness = x @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None]
    for i, found in listed(graph).items():
        assert found == sorted((max(0.0, round(1 - likeness[i, j], 9)), j) for j in range(300) if j != i)[:3]


def test_encoder_is_made_of_digests_in_small_batches(spark):
    import hashlib

    vectors, mask = dense.hash_encoder(3)()(["a  b", "", "c"])
    assert vectors.shape == (3, 2, 3) and mask.tolist() == [[1, 1], [0, 0], [1, 0]]
    assert vectors[0, 1].tolist() == [b / 255 for b in hashlib.md5(b"b").digest()[:3]] and not vectors[1].any()
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    dense.encode_texts(spark.createDataFrame([(1, "x")], "id int, text string"), dense.hash_encoder(2))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


@pytest.mark.parametrize("metric", ["jaccard", "cosine"])
def test_term_products_hold_a_bounded_number_of_meetings(monkeypatch, metric):
    """Articles that share most of their terms: every pair of entries at once would be a hundred times as much."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 300, 250)) for _ in range(400)]
    sizes = np.array([len(x) for x in rows])
    codes = np.concatenate(rows)
    terms = spaces.Terms(np.concatenate([[0], np.cumsum(sizes)]), codes, np.ones(len(codes)) if metric == "jaccard" else rng.random(len(codes)))
    space = spaces.TermSpace(metric)
    dense = np.zeros((400, 300))
    dense[terms.rows, terms.codes] = terms.weights
    both = dense @ dense.T
    want = 1 - (both / (sizes[:, None] + sizes - both) if metric == "jaccard" else both)
    for share in (0.01, 2.0):
        monkeypatch.setattr(spaces, "DENSE_SHARE", share, raising=False)
        monkeypatch.setattr(spaces, "MEETINGS", 1 << 16, raising=False)
        tracemalloc.start()
        found = space.distances(terms, terms)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.allclose(found, np.maximum(want, 0), atol=2e-9)
        assert most < 40e6
