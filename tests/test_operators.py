import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import colors, dashboard, duplicates, evaluate, feed, images, paging, popularity, recommend, skew, store, topics
from mosaiq.operators.filters import every, form_errors, matches, validate, visible_to
from mosaiq.runtime import Scratch, dense_ids
from mosaiq.sources import external, images as image_files, sinks, tables

PIN = "id string, title string, description string, author_id string, created_at timestamp, visibility string"
T0 = datetime(2024, 1, 1)


def make_pins(spark, n=60):
    rows = [(f"p{i:03}", f"Title {i}", None if i % 7 == 0 else f"about {['lakes', 'dunes', 'boats'][i % 3]}", f"a{i % 4}", T0 + timedelta(hours=i // 3), [None, "public", "private"][i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, PIN)


def test_pages_partition_the_feed(spark):
    pins, got, cursor = make_pins(spark), [], None
    while True:
        page = paging.list_pins(pins, limit=7, cursor=cursor, viewer="a1")
        got += [r.id for r in page.rows.collect()]
        cursor = page.next_cursor()
        if cursor is None:
            break
    want = [r.id for r in pins.filter(visible_to("a1")).orderBy(F.desc("created_at"), F.desc("id")).collect()]
    assert got == want and len(set(got)) == len(got)


def test_bad_cursor_is_the_first_page(spark):
    pins = make_pins(spark)
    first = [r.id for r in paging.list_pins(pins, limit=5).rows.collect()]
    assert [r.id for r in paging.list_pins(pins, limit=5, cursor="??").rows.collect()] == first
    assert all(r.visibility != "private" for r in paging.list_pins(pins).rows.collect())


def test_page_is_a_top_k(spark):
    plan = paging.list_pins(make_pins(spark)).fetched._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_filters_reach_the_scan(spark):
    plan = spark.read.parquet("/root/testdata/sf0.001/pins.parquet").select("id", "author_id", "visibility").filter(every(F.col("author_id") == "x"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(author_id), EqualTo(author_id,x)]" in plan and "title" not in plan


def test_filters_go_below_the_removal_of_repeated_rows(spark):
    pins = tables.pins(spark, "/root/testdata/sf0.001", "created_at", "author_id", "visibility", "title")
    plan = paging.list_pins(pins, author="x").fetched.drop("title")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(author_id,x)" in plan and "TakeOrderedAndProject" in plan


def test_visibility_and_validation(spark):
    pins = make_pins(spark, 9)
    assert {r.visibility for r in store.normal_visibility(pins).collect()} == {"public", "private"}
    changed = store.set_visibility(pins, "p001", "a1", "private").filter("id = 'p001'").first()
    unchanged = store.set_visibility(pins, "p001", "a2", "private").filter("id = 'p001'").first()
    assert (changed.visibility, unchanged.visibility) == ("private", "public")
    bad = validate(pins.withColumn("title", F.lit("")).withColumn("phash", F.lit("XYZ"))).first().broken
    assert bad == ["title_length", "phash_format"]


def test_matches_prefixes_and_substring(spark):
    pins = make_pins(spark, 9)
    assert {r.id for r in pins.filter(matches("Boat")).collect()} == {"p002", "p005", "p008"}
    assert pins.filter(matches("lake")).count() == 0  # lakes has the stem lak
    assert pins.filter(matches("TITLE 1")).count() == 9 and pins.filter(matches("e 1")).count() == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_skew_join_is_the_plain_join(spark, how):
    left = spark.createDataFrame([(i % 5 if i > 40 else 0, i) for i in range(80)] + [(None, 99)], "k int, x int")
    right = spark.createDataFrame([(k, j) for k in (0, 0, 0, 1, 2, 7) for j in range(4)] + [(None, 1)], "k int, y int")
    want = sorted(map(str, left.join(right, ["k"], how).collect()))
    assert sorted(map(str, skew.skew_join(left, right, ["k"], how, least=3).collect())) == want
    assert skew.skew_join(left.limit(0), right, ["k"], how, least=3).count() == 0


def test_dense_ids(spark):
    keys = spark.createDataFrame([(f"k{i * 37 % 101:03}",) for i in range(101)], "k string").repartition(7)
    got = {r.k: r.n for r in dense_ids(Scratch(spark, "t"), keys, ["k"], "ids").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    assert dense_ids(Scratch(spark, "t"), keys.limit(0), ["k"], "ids").count() == 0


def brute_pairs(items, t):
    return sorted((a, b, bin((x ^ y) & (1 << 64) - 1).count("1")) for a, x in items for b, y in items if a < b and bin((x ^ y) & (1 << 64) - 1).count("1") <= t)


@pytest.mark.parametrize("t", [0, 3, 10, 18, 24])
def test_duplicate_pairs_against_brute_force(spark, t):
    rng = random.Random(t)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(12)]
    items = []
    for i in range(70):
        h = rng.choice(base)
        for _ in range(rng.randrange(0, 22)):
            h ^= 1 << rng.randrange(63)
        items.append((i, h))
    df = spark.createDataFrame(items + [(900, None)], "id bigint, h bigint")
    got = sorted((r.a, r.b, r.distance) for r in duplicates.duplicate_pairs(df, t).collect())
    assert got == brute_pairs(items, t)


def test_duplicate_groups(spark):
    rows = [("a", 0), ("b", 0), ("c", 0b111), ("d", 0b111111), ("e", -1), ("f", None), ("g", 1 << 40)]
    df = spark.createDataFrame(rows, "id string, h bigint")
    got = sorted(tuple(r) for r in duplicates.duplicate_groups(df, 3).collect())
    assert got == [("a", i, 5, 7) for i in "abcdg"]  # d is 7 bits from g, though no link is longer than 3
    assert duplicates.duplicate_groups(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("hot", [5, 100_000])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(skew.skew_join, "__kwdefaults__", skew.skew_join.__kwdefaults__ | {"least": hot})
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(7, 7)]
    random.Random(1).shuffle(links)
    got = {r.id: r.group_id for r in duplicates.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(50)} | {i: 100 for i in range(100, 161)}


SAVES = [("aria", 1), ("noah", 1), ("kenji", 1), ("tomas", 1), ("aria", 10), ("noah", 10), ("kenji", 10), ("tomas", 3), ("eve", 4)]


def test_jaccard_of_savers(spark):
    saves = spark.createDataFrame([*SAVES, ("aria", 10), (None, 10)], "user_id string, pin_id int")
    got = {r.id: (r.shared, r.score) for r in recommend.saver_overlap(saves, 1).collect()}
    assert got == {10: (3, 0.75), 3: (1, 0.25)}
    pins = spark.createDataFrame([(i, "t", None, T0) for i in (1, 3, 4, 10)], "id int, title string, description string, created_at timestamp")
    assert [(r.id, r.reason) for r in recommend.related(pins, saves, 1, strategy="collaborative").collect()] == [(10, "3 people saved both"), (3, "1 person saved both")]


def test_hybrid_without_savers_gives_their_weight_to_content(spark):
    pins = spark.createDataFrame([(1, "red dune", None, T0), (2, "red boat", None, T0), (3, "lake", None, T0)], "id int, title string, description string, created_at timestamp")
    none = spark.createDataFrame([], "user_id string, pin_id int")
    got = {r.id: r for r in recommend.make_hybrid()(pins, none, 1, int(T0.timestamp() * 1000)).collect()}
    assert got[2].score == pytest.approx(0.9) and got[2].reason == "Both about “red”" and got[3].score == pytest.approx(0.1)
    assert recommend.ranker("nonsense") is recommend.RANKERS["hybrid"]
    assert recommend.related(pins.limit(0), none, 1, now=0).count() == 0


def test_ranker_of_the_session(spark):
    assert recommend.ranker(None, "content") is recommend.RANKERS["content"] and recommend.ranker(None, "x") is recommend.RANKERS["hybrid"]


def test_popularity(spark):
    pins = spark.createDataFrame([(1, T0), (2, T0), (3, T0)], "id int, created_at timestamp")
    saves = spark.createDataFrame(SAVES, "user_id string, pin_id int")
    comments = spark.createDataFrame([(1,), (1,), (1,), (2,)], "pin_id int")
    rows = popularity.rank_by_popularity(pins, saves, comments).orderBy("rank").collect()
    assert [(r["rank"], r.id, r.score) for r in rows] == [(1, 1, 15), (2, 3, 3), (3, 2, 1)]
    limited = popularity.rank_by_popularity(pins, saves, comments, limit=2).orderBy("rank").collect()
    assert [(r["rank"], r.id) for r in limited] == [(1, 1), (2, 3)]


def test_topics_bounds(spark):
    pins = make_pins(spark, 30)
    got = {r.term: r.df for r in topics.topics(pins).collect()}
    assert "title" not in got and set(got) <= {"lak", "lake", "dun", "boat"}
    assert topics.topics(pins.limit(0)).count() == 0


def test_activity_is_filled(spark):
    rows = dashboard.activity(make_pins(spark, 6), "2024-01-03").collect()
    assert len(rows) == 14 and rows[-3].pins == 6 and sum(r.pins for r in rows) == 6


def test_board(spark):
    pins = make_pins(spark, 12).withColumn("phash", F.lit("0f" * 8)).withColumn("source", F.lit("upload")).withColumn("public_id", F.col("id"))
    saves = spark.createDataFrame([("a1", "p001"), ("a2", "p001"), ("a1", "p004")], "user_id string, pin_id string")
    comments = spark.createDataFrame([(1, "p001"), (2, "p002")], "id int, pin_id string")
    swatches = spark.createDataFrame([("p001", 0, 255, 0, 0, 0.75), ("p001", 1, 0, 0, 255, 0.25)], "id string, pos int, r int, g int, b int, share double")
    parts = dashboard.dashboard_stats(pins, saves, comments, swatches, "a1", "2024-01-01")
    assert tuple(parts["counts"].first()) == (3, 2, 1)
    assert [(r.family, r.weight) for r in parts["palette"].collect()] == [("red", 0.75), ("blue", 0.25)]
    assert parts["duplicates"].first().duplicate_groups == 1
    gone = store.delete_pins(pins, saves, comments, spark.createDataFrame([("p001", "a1"), ("p002", "nobody")], "id string, author_id string"))
    assert [gone[k].count() for k in ("pins", "saves", "comments", "assets")] == [11, 1, 1, 1]


def test_toggles(spark):
    state = spark.createDataFrame([("u", "a"), ("u", "b")], "user_id string, pin_id string")
    flips = spark.createDataFrame([("u", "a"), ("u", "c"), ("u", "d"), ("u", "d")], "user_id string, pin_id string")
    assert sorted(r.pin_id for r in store.toggle_saves(state, flips).collect()) == ["b", "c"]


def test_insert_absent_keeps_nulls_apart(spark):
    kind = "k int, v string"
    out = store.insert_absent(spark.createDataFrame([(1, "old")], kind), spark.createDataFrame([(1, "x"), (2, "b"), (2, "a"), (None, "n"), (None, "m")], kind), ["k"])
    assert sorted((str(r.k), r.v) for r in out.collect()) == [("1", "old"), ("2", "a"), ("None", "m"), ("None", "n")]


def test_colour_search(spark):
    rows = [("a", 0, 255, 0, 0, 0.5), ("a", 1, 250, 0, 0, 0.5), ("b", 0, 0, 0, 255, 1.0), ("c", 0, 255, 0, 0, 0.2), ("c", 1, 0, 255, 0, 0.8)]
    sw = spark.createDataFrame(rows, "id string, pos int, r int, g int, b int, share double")
    got = colors.rank_by_color(sw, (255, 0, 0)).collect()
    assert [r.id for r in got] == ["a", "c"] and got[0].closest_delta == 0 and got[0].closest_hex == "#ff0000"
    assert colors.with_families(sw, ["blue"]).count() == 1


def test_evaluation(spark):
    df = spark.createDataFrame([(True, 2), (True, 12), (False, 11), (False, 30)], "positive boolean, distance int")
    sweep = {r.threshold: r for r in evaluate.threshold_sweep(df).collect()}
    assert (sweep[0].precision, sweep[0].recall, sweep[0].f1) == (1, 0, 0) and (sweep[12].tp, sweep[12].fp) == (2, 1)
    assert evaluate.best_threshold(evaluate.threshold_sweep(df)).first().threshold == 12 and evaluate.last_perfect_precision(evaluate.threshold_sweep(df)).first().threshold == 10
    values = spark.createDataFrame([("e", x) for x in (5, 1, 9, 7)], "g string, distance int")
    row = evaluate.group_stats(values, "g").first()
    assert (row["min"], row["median"], row["max"], row["caught"], row["total"]) == (1, 7, 9, 4, 4)
    assert evaluate.percentile(values, "distance", 0.5).first().distance == 7 and evaluate.percentile(values, "distance", 1.0).first().distance == 9


def test_dct_against_the_definition():
    m = np.random.default_rng(1).uniform(0, 255, (8, 8))
    c = lambda u: np.sqrt((1 if u == 0 else 2) / 8)
    want = [[c(u) * c(v) * sum(m[y, x] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for y in range(8) for x in range(8)) for v in range(8)] for u in range(8)]
    assert np.abs(images.dct2d(m) - np.array(want)).max() < 1e-9
    h = images.hash_of(np.random.default_rng(2).uniform(0, 255, 1024))
    assert len(h) == 16 and bin(int(h, 16)).count("1") == 32 and images.hash_of([1.0]) is None


def test_k_means():
    rng = np.random.default_rng(3)
    px = np.concatenate([rng.integers(0, 20, (300, 3)), rng.integers(200, 220, (100, 3))]).ravel()
    out = images.k_means(px, 2)
    assert [round(s["share"], 2) for s in out["swatches"]] == [0.75, 0.25] and images.k_means(px, 2) == out
    assert images.k_means([], 5)["swatches"] == [] and len(images.k_means([1, 2, 3] * 9, 5)["swatches"]) == 1
    assert sum(s["share"] for s in images.k_means(px, 5, 999)["swatches"]) == pytest.approx(1)
    assert images.Uniform(1).next() == pytest.approx(0.6270739405881613)


def test_images_take_their_turns_together():
    """Batches of images of several sizes give what each gives alone, and that is what the definition gives."""
    rng = np.random.default_rng(7)
    pics = [rng.integers(0, 256, 3 * n) for n in (200, 1, 200, 77, 0, 200, 3)] + [np.tile([9, 9, 9], 50)]
    seeds = list(range(len(pics)))
    together = images.k_means_all(pics, 4, seeds)
    assert together == [images.k_means(p, 4, s) for p, s in zip(pics, seeds, strict=True)]
    px = pics[0].reshape(-1, 3).astype(float)
    centres, turns = images._first_centres(px, 4, images.Uniform(0)), 0
    while turns < 40:
        turns, old = turns + 1, centres.copy()
        near = ((px[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for i in range(4):
            if (near == i).any():
                centres[i] = px[near == i].mean(0)
        if np.sqrt(((centres - old) ** 2).sum(1)).max() < 0.5:
            break
    got = together[0]
    assert got["iterations"] == turns and got["inertia"] == pytest.approx(((px - old[near]) ** 2).sum(1).mean())
    assert sorted(s["share"] for s in got["swatches"]) == sorted(np.bincount(near, minlength=4) / 200)
    assert {s["hex"] for s in got["swatches"]} == {"#%02x%02x%02x" % tuple(int(x + 0.5) for x in c) for c in centres}


def test_failed_images_are_told(spark):
    df = spark.createDataFrame([(1, [1.0] * 5, [1, 2, 3]), (2, None, None)], "id int, gray array<double>, pixels array<int>")
    got = {r.id: r for r in images.analyze(df).collect()}
    assert got[1].analyzed and got[1].phash is None and got[1].palette[0].hex == "#010203" and not got[2].analyzed and got[2].error


def test_image_files(spark, tmp_path):
    a = np.zeros((4, 8, 3), np.uint8)
    a[:, 4:] = (10, 20, 200)
    assert image_files.samples_of(a.tobytes(), 8, 4, 3)[-3:] == bytes([200, 20, 10])
    assert len(image_files.gray_of(a.tobytes(), 8, 4, 3)) == 1024
    assert len(image_files.samples_of(np.zeros((100, 200, 3), np.uint8).tobytes(), 200, 100, 3)) == 96 * 48 * 3
    (tmp_path / "x.bin").write_bytes(b"123")
    assert image_files.read_bytes(spark, str(tmp_path)).first().length == 3


def test_external_search(spark, tmp_path):
    hits = [{"id": 7, "tags": "sea, Sun,,sea", "user": "ann", "imageWidth": 4, "imageHeight": 3}, {"id": 8, "tags": "", "user": "bo"}]
    (tmp_path / "sea-1.json").write_text(json.dumps({"hits": hits}))
    spark.dataSource.register(external.ImageSearch)
    raw = spark.read.format("image_search").option("folder", str(tmp_path)).option("queries", json.dumps([" sea ", "", "none"])).load()
    rows = external.normalise(raw).orderBy("provider_id").collect()
    assert [(r.provider_id, r.title, r.tags, r.credit.name) for r in rows] == [("7", "Sea", ["sea", "sun"], "ann"), ("8", "Untitled", [], "bo")]
    assert external.normalise(external.read_hits(spark, str(tmp_path))).count() == 2
    assert external.image_by_id(external.normalise(raw), "7").count() == 1 and external.image_by_id(external.normalise(raw), "7x").count() == 0
    assert external.search_request("q", 0, 999)["per_page"] == 200 and external.search_request("  ") is None


def test_feed_ends(spark):
    pins = make_pins(spark, 9)
    found = spark.createDataFrame([(0, 1, 1, 5), (0, 1, 2, 6), (0, 2, 1, 7), (1, 1, 1, 5)], "topic int, page int, place int, id int")
    keys, cursor = [], None
    while True:
        rows, cursor = feed.feed_page(pins, found, cursor, 4, topics=2)
        keys += [r.key for r in rows.collect()]
        if cursor is None:
            break
    assert keys[:3] == [f"pin:{i}" for i in ("p007", "p004", "p001")] and keys[3:] == ["px:5", "px:6", "px:7", "px:5"]
    assert feed.feed_items(pins, found).filter("phase = 1").count() == 3


def test_sinks_and_tables(spark, tmp_path):
    sinks.write_pins(make_pins(spark, 9), str(tmp_path / "pins"))
    assert spark.read.parquet(str(tmp_path / "pins")).count() == 9
    sinks.write_report({"Numbers": spark.range(2)}, str(tmp_path / "report"))
    assert "| 1 |" in [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert spark.createDataFrame([], tables.PIN).count() == 0
    seeded = tables.seed_addresses(spark.createDataFrame([("x", "f"), ("y", "f")], "public_id string, fallback_url string"), ["x"], "https://e.invalid")
    assert [r.image_url for r in seeded.collect()] == ["https://e.invalid/x", "f"]


def test_seed(spark):
    from mosaiq.sources.seed import seed

    now = 1_700_000_000_000
    got = seed(spark, [{"id": str(i), "title": f"t{i}", "author_id": "a", "days_ago": float(20 - i)} for i in range(1, 15)], [{"id": "a", "name": "Ann"}], {"a": ["1", "2", "1"], "b": []}, [{"pin_id": "1", "author_id": "a", "body": "hi", "minutes_ago": 5}], now)
    first = paging.list_pins(got["pins"], limit=3)
    assert [r.id for r in first.rows.collect()] == ["14", "13", "12"]
    assert [r.id for r in paging.list_pins(got["pins"], limit=3, cursor=first.next_cursor()).rows.collect()] == ["11", "10", "9"]
    assert got["saves"].count() == 2 and tables.thread(got["comments"].withColumn("author", F.lit("x")), got["users"], "1").first().author == "Ann"


def test_streams(spark, tmp_path):
    from mosaiq.streaming import comments as live

    src = str(tmp_path / "in")
    rows = [(1, "p", " hi ", "n", "a", T0), (1, "p", " hi ", "n", "a", T0), (2, "p", "  ", "n", "a", T0), (3, "q", "yo", "n", "a", T0)]
    spark.createDataFrame(rows, live.SCHEMA).write.parquet(src)
    live.append_to(live.live_thread(live.accepted(live.read_comments(spark, src)), "p"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [(r.id, r.body) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "hi")]
    seen = []
    live.publish(live.read_comments(spark, src, 1), lambda b, n: seen.append(b.count()), str(tmp_path / "c2"), once=True).awaitTermination()
    assert sum(seen) == 4


@pytest.mark.parametrize("most", [7, 40, 1000])
def test_any_number_of_originals(spark, monkeypatch, most):
    monkeypatch.setattr(evaluate, "MOST_ORIGINALS", most)
    rng = random.Random(6)
    rows = [(i, rng.getrandbits(63), f"l{rng.randrange(4)}") for i in range(90)]
    df = spark.createDataFrame(rows, "id int, h long, label string")
    got = evaluate.labelled_distances(df, df.filter("id % 2 = 0"), "label")
    assert got.columns == ["id", "h", "label", "original_id", "positive", "distance"]
    want = sorted((*x, y[0], x[2] == y[2], (x[1] ^ y[1]).bit_count()) for x in rows for y in rows if y[0] % 2 == 0 and x[0] != y[0])
    assert sorted(map(tuple, got.collect())) == want


def test_kmeans_stats(spark):
    from math import dist

    from mosaiq.functions.color import lab_of

    rng = random.Random(8)
    pics = [(i, [rng.randrange(256) for _ in range(3 * 60)]) for i in range(5)]
    df = spark.createDataFrame([*pics, (9, None)], "id int, pixels array<int>")
    a, b = ([images.k_means(p, 5, seed) for _, p in pics] for seed in (1, 999))
    lab = lambda found: [lab_of(s["r"], s["g"], s["b"]) for s in found["swatches"]]
    drifts = [max(min(dist(s, o) for o in lab(y)) for s in lab(x)) for x, y in zip(a, b, strict=True)]
    r = evaluate.kmeans_stats(images.palettes(df, seed=1), images.palettes(df, seed=999)).collect()
    want = (sum(x["iterations"] for x in a) / 5, sum(drifts) / 5, max(drifts))
    assert len(r) == 1 and tuple(r[0]) == pytest.approx(want) and max(drifts) > 0


def test_streamed_counts_leave_no_comment_out(spark, tmp_path):
    """The last days, comments late by months, and rows that come twice, in one micro-batch and across them."""
    from mosaiq.streaming import comments as live

    src = str(tmp_path / "in")
    day = [T0 + timedelta(days=n) for n in (0, 60, 120)]
    files = [[(1, "p", day[0]), (1, "p", day[0]), (2, "p", day[1])], [(3, "p", day[2]), (2, "p", day[1])], [(4, "p", day[0]), (5, "q", day[1]), (3, "p", day[2])]]
    for rows in files:
        spark.createDataFrame([(i, p, "x", "n", "a", t) for i, p, t in rows], live.SCHEMA).coalesce(1).write.mode("append").parquet(src)
    live.counts_to(live.windowed_counts(live.read_comments(spark, src, 1)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {(r.start.date(), r.pin_id): r.comments for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(day[0].date(), "p"): 2, (day[1].date(), "p"): 1, (day[1].date(), "q"): 1, (day[2].date(), "p"): 1}


def test_daily_comments_of_a_stream_are_those_of_the_table(spark):
    from mosaiq.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    c = tables.comments(spark, d, "pin_id", "created_at")
    want = c.groupBy(F.date_trunc("day", "created_at").alias("t"), "pin_id").agg(F.count(F.lit(1)).alias("comments"))
    want = want.select((F.unix_micros(F.col("t").cast("timestamp")) / 1000).cast("bigint").alias("start_ms"), "pin_id", "comments")
    got = QUERIES["comment_stream_daily"](spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_missing_visibility_is_not_public(spark):
    pins = spark.createDataFrame([("a", "x", None), ("b", "x", "private"), ("c", "y", "public"), ("d", None, None), ("e", "y", "PUBLIC")], "id string, author_id string, visibility string")
    seen = lambda v: sorted(r.id for r in pins.filter(visible_to(v)).collect())
    assert seen(None) == seen("") == ["c"] and seen("x") == ["a", "b", "c"] and seen("y") == ["c", "e"]
    assert sorted(r.id for r in store.backfill_visibility(pins).filter(visible_to()).collect()) == ["a", "c", "d"]


def test_board_sorts_the_newest(spark):
    rows = [(f"p{i}", t, T0 + timedelta(hours=h), "me", "private" if i % 2 else None) for i, (t, h) in enumerate([("b", 1), ("a", 2), ("B", 3), ("a", 3), ("old", 0)])]
    pins = spark.createDataFrame([*rows, ("q", "z", T0, "other", "public")], "id string, title string, created_at timestamp, author_id string, visibility string")
    order = lambda sort: [r.id for r in store.board(pins, "me", sort, 4).collect()]
    assert order("newest") == order("?") == ["p3", "p2", "p1", "p0"] and order("oldest") == ["p0", "p1", "p2", "p3"] and order("title") == ["p3", "p1", "p0", "p2"]
    assert store.private_count(pins, "me", 4).first().private_pins == 2 and store.private_count(pins.limit(0), "me").first().private_pins == 0


def test_created_pins(spark):
    stored = spark.createDataFrame([("me", "pix", "1"), ("you", "pix", "2"), ("me", None, "3")], "author_id string, provider string, provider_id string")
    kind = "title string, image_url string, author_id string, provider string, provider_id string, public_id string, source string, visibility string, tags array<string>"
    new = [("Dune", "u", "me", "pix", "1", None, None, None, None), ("Dune", "u", "me", "pix", "2", "x", None, None, []), ("Dune", "v", "me", "pix", "2", "", None, None, ["a"]), ("!", "u", "me", None, None, "", "seed", "private", ["t"]), ("Ö", "u", "me", None, "3", None, None, None, None)]
    out = store.create_pins(stored, spark.createDataFrame(new, kind), now=1000, suffix=F.lit("abc123"))
    got = sorted((r.id, r.image_url, r.source, r.visibility, r.tags, r.created_at.timestamp()) for r in out["created"].collect())
    assert got == [("dune-abc123", "u", "upload", "public", None, 1.0), ("pin-abc123", "u", "seed", "private", ["t"], 1.0)]
    assert sorted((r.title, r.image_url) for r in out["already_saved"].collect()) == [("Dune", "u"), ("Dune", "v"), ("Ö", "u")]
    ids = {r.id for r in store.create_pins(stored.limit(0), spark.createDataFrame(new[:3], kind), now=0)["created"].collect()}
    assert len(ids) == 2 and all(len(i) == 11 for i in ids)


def test_forgotten_pins(spark):
    comments = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, pin_id string")
    out = store.forget_pins(comments, spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "id string"))
    assert sorted(r.id for r in out["left"].collect()) == [3, 4] and sorted(tuple(r) for r in out["removed"].collect()) == [("a", 2), ("z", 0)]


def test_analysis_within_a_request_and_after_it(spark):
    swatch = images.SWATCH
    pins = spark.createDataFrame([(i, None, None, None, None) for i in "abc"], f"id string, phash string, palette {swatch}, color_families array<string>, analyzed_at timestamp")
    found = spark.createDataFrame([("a", "0" * 16, [(255, 0, 0, "#ff0000", 1.0)], True, T0), ("b", None, None, False, T0)], f"id string, phash string, palette {swatch}, analyzed boolean, analyzed_at timestamp")
    at = lambda df: {r.id: (r.phash, r.color_families, r.analyzed_at) for r in df.collect()}
    assert at(store.store_analysis(pins, found)) == {"a": ("0" * 16, ["red"], T0), "b": (None, None, None), "c": (None, None, None)}
    assert at(store.set_analysis(pins, found))["b"] == (None, None, T0)


def test_rules_of_palettes_and_forms(spark):
    rows = [(1, "pixabay", [(0, 255, 3, "#00ff03", 0.5)]), (2, "other", [(0, 256, 3, "#00ff03", 0.5)]), (3, None, [(0, 1, 3, "#00FF03", 0.5)]), (4, None, [(0, 1, 3, "#00ff03", 1.5)] * 13), (5, None, None), (6, None, [(None, 1, 3, "#00ff03", 0.5)])]
    got = {r.id: r.broken for r in validate(spark.createDataFrame(rows, f"id int, provider string, palette {images.SWATCH}")).collect()}
    assert got == {1: [], 2: ["provider_known", "palette_colors"], 3: ["palette_colors"], 4: ["palette_size", "palette_colors"], 5: [], 6: ["palette_colors"]}
    forms = [("t", "d" * 500, None, None), ("t" * 121, "d" * 501, "image/png", 5), (" ", None, "image/bmp", 5), ("x", None, "image/png", 11 << 20), (None, None, None, None)]
    got = [r.errors for r in form_errors(spark.createDataFrame(forms, "title string, description string, mime string, size long")).collect()]
    assert got == [[], ["title", "description"], ["title", "mime"], ["mime"], ["title"]]


def test_images_are_analysed_once(spark):
    from mosaiq.plans.queries import QUERIES

    plan = QUERIES["kmeans_palette"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cluster(") == 1 and plan.count("draw(") == 1


def test_edits():
    a = np.random.default_rng(4).uniform(0, 255, (40, 56, 3))
    every = images.edits()
    assert len(every) == 16 and [n for n, (_, ok) in every.items() if not ok] == ["rotate 90°", "flip horizontal"]
    done = {n: f(a) for n, (f, _) in every.items()}
    assert all(x.min() >= 0 and x.max() <= 255 and x.shape[2] == 3 for x in done.values())
    assert done["resize to 25%"].shape[:2] == (10, 14) and done["resize to 150%"].shape[:2] == (60, 84) and done["crop 15%"].shape[:2] == (34, 48) and done["rotate 90°"].shape[:2] == (56, 40)
    flat = np.full((24, 24, 3), 77.0)
    assert all(np.abs(every[n][0](flat) - 77).max() < 8 for n in ("re-encode JPEG q15", "blur", "sharpen", "saturation +50%", "greyscale"))
    assert np.abs(images._quantised(a, 95) - a).mean() < np.abs(done["re-encode JPEG q15"] - a).mean()
    assert np.abs(every["blur"][0](a).mean() - a.mean()) < 4 and np.array_equal(a, every["convert to PNG"][0](a))


def test_hashes_of_a_batch_are_those_of_each():
    rng = np.random.default_rng(5)
    grays = [rng.uniform(0, 255, 1024), None, [1.0], rng.uniform(0, 255, 1024), [float("nan")] * 1024]
    got = images.hashes_of(grays)
    assert got == [images.hash_of(g) for g in grays] and got[1:3] == [None, None] and got[4] is None
    block = images.dct2d(grays[0].reshape(32, 32))[:8, :8].ravel()
    assert got[0] == f"{int(''.join('01'[int(b)] for b in block > np.median(block[1:])), 2):016x}"


def png(a):
    """A picture as the bytes of a file."""
    import struct
    import zlib

    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_files_to_palettes(spark, tmp_path):
    a = np.zeros((48, 96, 3), np.uint8)
    a[:, 48:] = (200, 20, 10)
    (tmp_path / "a.png").write_bytes(png(a))
    (tmp_path / "b.png").write_bytes(b"no picture")
    rows = image_files.matrices(image_files.read_images(spark, str(tmp_path)))
    files = image_files.read_bytes(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(files, "name")
    r = images.analyze(rows, k=2, content="content").collect()
    assert [(x.name, x.width, x.height, len(x.phash), [s.hex for s in x.palette], x.error) for x in r] == [("a.png", 96, 48, 16, ["#000000", "#c8140a"], None)]


def test_scratch_is_closed_and_needs_a_shared_folder(spark, tmp_path):
    from pathlib import Path

    from mosaiq import runtime

    with Scratch(spark, "t") as s:
        s.save(spark.range(3), "x")
        s.part("inner").save(spark.range(3), "y")
        at = Path(s.root.removeprefix("file:").replace("//", "/"))
        assert at.exists()
    assert not at.exists()

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d: d)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: Cluster.none)

        class none:
            getCheckpointDir = staticmethod(lambda: Cluster.empty)

        class empty:
            isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        runtime.shared_dir(Cluster)


def test_hot_keys_are_fewer_than_partitions():
    assert skew.hot_limit(10**12, 10**5, 100_000) == 10**7 and skew.hot_limit(1000, 8, 100_000) == 100_000


def test_equal_rows_of_a_hot_key_are_cut(spark):
    left = Scratch(spark, "t").save(spark.createDataFrame([(0, 1)] * 600 + [(i, 2) for i in range(1, 30)], "k int, x int").repartition(3), "l")
    right = spark.createDataFrame([(k, k) for k in range(30)], "k int, y int")
    out = skew.skew_join(left, right, ["k"], unique=True, least=10)
    assert out.count() == 629 and "_bl" in out._jdf.queryExecution().optimizedPlan().toString()


def test_bands_suit_the_number_of_hashes():
    for t in range(25):
        for n in (1, 10_000, 10**8):
            plan = duplicates._band_plan(t, n)
            assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for _, _, r in plan) >= min(64, t + 1)
    assert len(duplicates._band_plan(10, 10**3)) > len(duplicates._band_plan(10, 10**7))


def test_comments_are_made(spark):
    from mosaiq.streaming import comments as live

    typed = spark.createDataFrame([("p", " hi ", "n", "a"), ("p", " \t", "n", "a"), ("p", "x" * 1001, "n", "a"), ("p", None, "n", "a")], "pin_id string, body string, author string, author_id string")
    made = live.new_comments(typed)
    assert made.schema.simpleString() == spark.createDataFrame([], live.SCHEMA).schema.simpleString() and [r.body for r in made.collect()] == ["hi"]


def test_cursors_as_columns(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(milliseconds=n)) for n, i in enumerate(["a", "a.b", "é?>", "x" * 90])], "id string, created_at timestamp")
    rows = paging.read_cursors(paging.cursors(df)).collect()
    for r in rows:
        assert paging.decode_cursor(r.cursor) == (r.cursor_ms, r.cursor_id) == (int(r.created_at.timestamp() * 1000 + 0.5), r.id)
        assert r.cursor == paging.encode_cursor(r.cursor_ms, r.cursor_id)
    bad = spark.createDataFrame([("?",), (None,), ("",), ("QQ",), ("LmE",)], "cursor string")
    assert all(r.cursor_ms is None and r.cursor_id is None for r in paging.read_cursors(bad).collect())


def test_a_dry_topic_is_passed_over(spark):
    pins = make_pins(spark, 0 + 1).limit(0)
    found = spark.createDataFrame([(4, 1, 1, 7), (4, 3, 1, 8), (6, 1, 1, 9)], "topic int, page int, place int, id int")
    keys, cursor = [], None
    while True:
        rows, cursor = feed.feed_page(pins, found, cursor, 4, topics=8)
        keys.append([r.key for r in rows.collect()])
        if cursor is None:
            break
    assert [k for k in keys if k] == [["px:7"], ["px:9"]]


def test_the_library_stands_without_the_optional_package():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "mosaiq"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "mosaiq.llm" in p.read_text()]
