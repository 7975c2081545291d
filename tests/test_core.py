"""Core operators on hand-made rows, against brute force, and the registered queries against DuckDB."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import geometry as g
from glyphmill.functions import text as t
from glyphmill.operators import components, folds, labels, matching, metrics, multivalue, stats
from glyphmill.plans import registry
from glyphmill.sources import readers
from glyphmill.streaming import ingest

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("~" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_text(spark):
    L = F.lit
    words = lambda s: F.split(L(s), " ")
    r = one(spark, t.lev_infix(L("xxhallo"), L("hello")), t.lev_infix(L("abc"), L("")), t.lev_infix(L(""), L("abc")), t.lcs_len(words("a b c d"), words("b x d")), t.lev_tokens(words("a b c"), words("a c")), t.norm_key(L("Ａb-한 글!")), t.similarity(L(""), L("")))
    assert list(r) == [1, 0, 3, 2, 1, "ab한글", 1.0]
    assert one(spark, t.split_lines(L("a\\nb|c\r\n|###")))[0] == ["a\nb", "c", "###"]
    assert one(spark, t.split_lines(L(" a\r\n\\n b ")))[0] == ["a", "b"]
    assert one(spark, t.bigrams(L("aaa")), t.bigrams(L("x")), t.bigrams(L("")))[0:3] == (["aa"], ["x"], [])
    assert one(spark, t.json_object(L('well {"name": "x"} ok'), "name string")["name"], t.json_object(L("none"), "name string")["name"])[0:2] == ("x", None)
    assert one(spark, t.json_lines(L('["a","b"]'), F.array(L("x"), L("y"))), t.json_lines(L('["a"]'), F.array(L("x"), L("y"))))[0:2] == (["a", "b"], ["x", "y"])
    assert one(spark, t.guess_name(F.array(L("OPEN"), L("02-0000-8306"), L("Blue Cafe"), L("Gold Cafe"))))[0] == "Blue Cafe"


def test_infix_brute_force(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 7))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))) for _ in range(60)]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    got = spark.createDataFrame(pairs, "p string, g string").select("p", "g", t.lev_infix(F.col("p"), F.col("g")).alias("d")).collect()
    for r in got:
        assert r["d"] == min(lev(r["p"][i:j], r["g"]) for i in range(len(r["p"]) + 1) for j in range(i, len(r["p"]) + 1))


def test_geometry(spark):
    b = lambda *v: g.box(*[F.lit(x) for x in v])
    r = one(spark, g.iou(b(0, 0, 2, 2), b(2, 0, 4, 2)), g.iou(b(0, 0, 2, 2), b(0, 0, 2, 2)), g.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)), g.inside(b(1, 1, 2, 2), b(0, 0, 4, 4)), F.size(g.stripes(F.lit(0), F.lit(0), F.lit(100), F.lit(10))))
    assert list(r) == [0.0, 1.0, 0.0, 1.0, 3]
    p = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((9, 9), (0, 0), (9, 0), (0, 9))])
    assert [tuple(q) for q in one(spark, g.order_points(p))[0]] == [(0, 0), (9, 0), (9, 9), (0, 9)]
    d = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (1, 1, 2, 1)])
    assert len(one(spark, g.dedup_points(d))[0]) == 2


def test_matching_brute_force(spark):
    rng = random.Random(7)
    boxes = [(f"p{i % 3}", i, rng.randint(0, 300), rng.randint(0, 300), rng.randint(5, 200), rng.randint(5, 200)) for i in range(90)]
    df = spark.createDataFrame(boxes, "photo string, id int, x int, y int, w int, h int").withColumn("box", g.xywh_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    iou = lambda a, b: max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))

    def ratio(a, b):
        i = iou(a, b)
        return i / (a[4] * a[5] + b[4] * b[5] - i)

    pred, truth = [x for x in boxes if x[1] % 2], [x for x in boxes if not x[1] % 2]
    used, want = set(), set()
    for a in sorted(pred, key=lambda a: (-(a[4] * a[5]), a[1])):
        c = sorted((-ratio(a, b), b[1]) for b in truth if b[0] == a[0] and b[1] not in used and ratio(a, b) >= 0.1)
        if c:
            used.add(c[0][1])
            want.add((a[1], c[0][1]))
    m = matching.match_boxes(df.where("id % 2 = 1").select("photo", F.col("id").alias("a"), "box", (F.col("w") * F.col("h")).cast("double").alias("conf")), df.where("id % 2 = 0").select("photo", F.col("id").alias("b"), "box"), "photo", 0.1).collect()
    assert {(r["a"], r["b"]) for r in m if r["status"] == "TP"} == want
    assert len(m) == len(pred) + len(truth) - len(want)
    kept = []
    for a in sorted(boxes, key=lambda a: (-(a[4] * a[5]), a[1])):
        if all(a[0] != k[0] or ratio(a, k) <= 0.3 for k in kept):
            kept.append(a)
    got = matching.suppress(df.select("photo", "id", "box"), "photo", [-g.area(F.col("box"))], 0.3)
    assert {r["id"] for r in got.collect()} == {k[1] for k in kept}


def test_lines_and_votes(spark):
    a = spark.createDataFrame([("c", 1, "abc"), ("c", 2, "xyz"), ("d", 1, "solo")], "crop string, t int, text string")
    b = spark.createDataFrame([("c", 1, "xyz"), ("c", 2, "abd"), ("c", 3, "zzz")], "crop string, p int, text string")
    got = {(r["crop"], r["t"]): (r["p"], r["edits"]) for r in matching.match_lines(a, b, "crop").collect()}
    assert got == {("c", 1): (2, 1), ("c", 2): (1, 0), ("d", 1): (None, 4)}
    p = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(i).alias("id")) for y, x, i in ((10.0, 5.0, 1), (12.0, 1.0, 2), (40.0, 1.0, 3), (14.0, 9.0, 4))])
    assert one(spark, matching.group_lines(p, F.lit(5.0)))[0] == [[2, 1, 4], [3]]


def test_average_precision(spark):
    h = spark.createDataFrame([("r", 0.9, True, "a"), ("r", 0.8, False, "b"), ("r", 0.7, True, "c"), ("q", 0.5, False, "d")], "region string, conf double, hit boolean, k string")
    n = spark.createDataFrame([("r", 2), ("q", 1), ("z", 3)], "region string, total long")
    got = {r["region"]: r["ap_all"] for r in metrics.average_precision(h, "region", "conf", "hit", "k", n).collect()}
    assert got["r"] == pytest.approx(0.8333, abs=1e-4) and got["q"] == 0 and got["z"] == 0


def test_components_and_folds(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d"), ("x", None), ("f", "e"), ("a", "b")], "a string, b string")
    assert {tuple(r) for r in components.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "e")}
    assert components.components(e.limit(0)).count() == 0
    i = spark.createDataFrame([("s", f"p{k}", f"k{k // 3}") for k in range(30)] + [("u", "p1", "k0"), ("u", "q", None)], "region string, photo string, name string")
    got = folds.assign_folds(folds.shared_groups(i, "photo", "region", "name"), "region", 5)
    assert folds.leaks(got.where("region = 's'"), "group_id", "fold").count() == 0
    assert {r["count"] for r in got.where("region = 's'").groupBy("fold").count().collect()} == {6}
    for sizes in ({1: 1000}, {7: 3, 2: 11, 1: 5}, {100: 1, 1: 40}):
        plan = folds.level(sizes, 4)
        load = {f: 0 for f in range(4)}
        for s, _, n, f in plan:
            load[f] += s * n
        assert sum(load.values()) == sum(s * n for s, n in sizes.items()) and max(load.values()) - min(load.values()) <= max(sizes)


def test_labels_and_stats(spark):
    m = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), (None, 9, "z"), ("k", 2, "b")], "key string, o int, v string")
    assert labels.latest(m, "key", "o").collect()[0]["v"] == "c"
    s = labels.scored(m, [("x", 2, F.col("v") == "c"), ("y", 1, F.col("o") > 1)]).where("o = 3").collect()[0]
    assert (s["suspicion"], s["reasons"]) == (3, ["x", "y"])
    p = spark.createDataFrame([(f"p{i}", 8 + i % 2, 10, 5 + i % 3, 10) for i in range(60)], "photo string, num_a int, den_a int, num_b int, den_b int")
    r = stats.paired_bootstrap(p, "photo", 300).collect()[0]
    assert r["lo"] < r["diff"] < r["hi"] and r["units"] == 60


def test_multivalue(spark):
    rows = [("g__1", 'a; "b; c" ;###'), ("g__2", "1,500원, x"), ("g__3", None), ("g__4", ""), ("g__5", "single"), ("g__1", 'a; "b; c" ;###'), ("g__6", '"""No. 7"" Bar"\\n24/7'), ("g__7", "v;" * 30000), ("g__8", '"open;q'), ("h__1", "; ;")]
    df = spark.createDataFrame([(*r, 1, "v") for r in rows], "image_name string, gt_text string, pos int, value string")
    got = {}
    for r in multivalue.split_values(df, ["image_name"], "gt_text", F.substring_index("image_name", "__", 1)).orderBy("image_name", "pos").collect():
        got.setdefault(r["image_name"], []).append(r["value"])
    assert got["g__1"] == ["a", "b; c", "###"] and got["g__6"] == ['"No. 7" Bar', "24/7"] and got["g__8"] == ['"open', "q"]
    assert len(got["g__7"]) == 30000 and got["g__5"] == ["single"] and "g__3" not in got and "g__4" not in got and "h__1" not in got
    assert "1,500원" in got["g__2"][0]
    assert multivalue.split_values(df.limit(0), ["image_name"], "gt_text").count() == 0


def test_separators_per_source(spark):
    """A mark separates in the source where it leaves values, not where it is part of them; values need not recur."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = [(f"a__{i}", f"{word()}; {word()}; {word()}") for i in range(60)] + [(f"a__s{i}", word()) for i in range(60)] + [(f"a__m{i}", f"K{i}/{word()}#{i}; {word()}") for i in range(60)]
    rows += [(f"b__{i}", f"cafe{i % 5} / bar{i % 7}") for i in range(60)] + [(f"b__s{i}", f"cafe{i % 5}") for i in range(9)] + [(f"b__t{i}", f"bar{i % 7}") for i in range(9)]
    df = spark.createDataFrame(rows, "image_name string, gt_text string")
    source = F.substring_index("image_name", "__", 1)
    got = {(r["source"], r["mark"]): r for r in multivalue.separator_scores(df, "gt_text", source).collect()}
    assert got["a", ";"]["accepted"] and not got["a", "/"]["accepted"] and got["b", "/"]["accepted"] and ("b", ";") not in got
    assert got["a", ";"]["consistency"] == 0.5 and got["b", "/"]["consistency"] == 1 and got["b", "/"]["recurrence"] == 1 and got["b", "/"]["regularity"] == 1
    values = {r["image_name"]: r["n_values"] for r in multivalue.split_values(df, ["image_name"], "gt_text", source).collect()}
    assert values["a__0"] == 3 and values["a__m7"] == 2 and values["b__3"] == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffimage_name,gt_text\na.jpg,"x\ny"\na.png,z\n,q\n', encoding="utf-8")
    d = readers.read_csv(spark, str(tmp_path / "a.csv")).withColumn("o", F.monotonically_increasing_id())
    assert {tuple(r) for r in readers.text_map(d, "o").collect()} == {("a", "z")}
    readers.write_lines_csv(spark.createDataFrame([("a", 'x\n"y"')], "image_name string, gt_text string"), str(tmp_path / "out"))
    assert readers.read_csv(spark, str(tmp_path / "out")).collect()[0]["gt_text"] == 'x\\n"y"'
    y = readers.yolo_labels(spark.createDataFrame([("p", "0 0.5 0.5 0.2 0.4")], "photo string, value string"), spark.createDataFrame([("p", 100, 50)], "photo string, w int, h int")).collect()[0]
    assert [round(v, 6) for v in y["box"]] == [40, 15, 60, 35]
    j = readers.detections_json(spark.createDataFrame([('{"p": {"size": [9, 8], "boxes": [[1, 2, 3, 4, 0.5]]}}',)], "value string")).collect()[0]
    assert (j["photo"], j["conf"], j["box"]["x1"]) == ("p", 0.5, 3.0)
    readers.numbered_samples(spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string"), "path", "text", str(tmp_path / "kv"))
    assert spark.read.parquet(str(tmp_path / "kv")).count() == 5  # two of each sample and their number


def test_streaming(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([("k", 2, "b"), ("j", 1, "x")], "key string, o int, v string").coalesce(1).write.json(src)
    ingest.ingest_new(spark, src, "key string, o int, v string", out, cp).awaitTermination()
    spark.createDataFrame([("k", 1, "late"), ("j", 5, "new")], "key string, o int, v string").coalesce(1).write.mode("append").json(src)
    ingest.ingest_new(spark, src, "key string, o int, v string", out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    stream = spark.readStream.format("json").schema("key string, o int, v string").option("maxFilesPerTrigger", 1).load(src)
    ingest.maintain_latest(stream, "key", "o", str(tmp_path / "state"), str(tmp_path / "cp2")).awaitTermination()
    assert {(r["key"], r["v"]) for r in spark.read.parquet(str(tmp_path / "state/1")).collect()} == {("k", "b"), ("j", "new")}


def test_keys_of_every_script(spark, tmp_path):
    import re
    import unicodedata
    from collections import Counter

    names = ["Ｃａｆé 12", "가나다", "雲山 Bar", "Bar", "bar", None, "", "가나 다"]
    spark.createDataFrame([("r", n) for n in names], "region string, name string").write.parquet(f"{tmp_path}/tagging_gt_v1.parquet")
    texts = ["가나 가나 Ｂar bar BAR", "가나 雲山 ok", None, "ok ok!"]
    spark.createDataFrame([(x,) for x in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda x: re.sub("[^0-9a-z가-힣]", "", unicodedata.normalize("NFKC", x).lower())
    want = Counter(key(n) for n in names if n is not None)
    got = registry.queries()["norm_keys_all"](spark, str(tmp_path)).collect()
    assert {r["key"]: r["records"] for r in got} == want and len(got) == len(want)
    uses = Counter(key(w) for x in texts if x for w in x.split())
    got = {r["key"]: r["freq"] for r in registry.queries()["vocab_min_freq_all"](spark, str(tmp_path)).collect()}
    assert got == {k: n for k, n in uses.items() if len(k) >= 2 and n >= 3} and set(got) == {"가나", "bar", "ok"}


def test_splits_in_any_spelling(spark, tmp_path):
    rows = [("1", "a", "Training"), ("2", "a", " VAL"), ("3", "b", "tst"), ("4", "c", "trn"), ("5", "c", "test"), ("6", None, "train"), ("7", "b", "other"), ("8", "d", None)]
    spark.createDataFrame(rows, "annotation_id string, text string, split string").write.parquet(f"{tmp_path}/crop_manifest.parquet")
    q = registry.queries()
    assert {tuple(r) for r in q["seen_unseen"](spark, str(tmp_path)).select("split", "seen", "crops", "texts").collect()} == {("val", True, 1, 1), ("test", False, 1, 1), ("test", True, 1, 1)}
    assert {tuple(r) for r in q["split_intersections"](spark, str(tmp_path)).select("splits", "texts").collect()} == {("train+val", 1), ("test", 1), ("test+train", 1)}


def test_workers(spark):
    from glyphmill.operators import workers

    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)] + [(20, None)], "key int, path string")

    def make():
        tried = {}

        def call(p):
            tried[p] = tried.get(p, 0) + 1
            if p in (None, "p3") or (p == "p4" and tried[p] < 3):
                raise OSError(p)
            return p.upper(), 0.5

        return call

    got = {r["key"]: (r["text"], r["score"]) for r in workers.run_worker(df, "key", "path", make).collect()}
    assert len(got) == 21 and got[3] == ("", 0.0) and got[4] == ("P4", 0.5) and got[20] == ("", 0.0)
    with pytest.raises(ValueError):
        workers.run_worker(df, "key", "path", make, budget=20)
    with pytest.raises(Exception, match="in a row"):
        workers.run_worker(df.where("key = 3"), "key", "path", make, most_failures=1).collect()

    def model():
        def call(texts):
            if len(texts) > 2 or "p5" in texts:
                raise ValueError("too many")
            return [[3.0, 4.0] for _ in texts]

        return call

    v = {r["key"]: r["embedding"] for r in workers.embed(df, "key", "path", model).collect()}
    assert v[0] == [0.6, 0.8] and v[5] is None and v[20] is None and len(v) == 21


def test_scoring_brute_force(spark):
    """The counters of every crop against a plain one-pass computation."""
    from glyphmill.operators import scoring

    rng = random.Random(9)
    words = ["가게", "커피", "bar", "No.1", "24시", "cafe", "가 게", "1588-1234", "123456789"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    gt = {f"c{i}": "\n".join(rng.choice([line(), line(), "###"]) for _ in range(rng.randint(0, 3))) for i in range(40)}
    pred = {k: "\n".join(rng.choice([line(), *v.split("\n")]) for _ in range(rng.randint(0, 4))) for k, v in gt.items() if rng.random() < 0.9}

    def lev(a, b, free=False):
        row = [0] * (len(a) + 1) if free else list(range(len(a) + 1))
        for y in b:
            new = [row[0] + 1]
            for j, x in enumerate(a, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row) if free else row[-1]

    def lcs(a, b):
        d = {}
        for i in range(len(a)):
            for j in range(len(b)):
                d[i, j] = d.get((i - 1, j - 1), 0) + 1 if a[i] == b[j] else max(d.get((i - 1, j), 0), d.get((i, j - 1), 0))
        return d.get((len(a) - 1, len(b) - 1), 0)

    def form(s):
        import re

        s = re.sub(r"\d{4}-\d{4}", " ", s.lower())
        return re.sub(r"[^0-9a-z가-힣\s]", "", s)

    want = {}
    for k, v in gt.items():
        every = [x.strip() for x in v.split("\n") if x.strip()]
        lines = [x for x in every if x != "###"]
        if not lines:
            continue
        opened = len(lines) < len(every)
        p = [x.strip() for x in pred.get(k, "").split("\n") if x.strip()]
        G, P = ["".join(form(x).split()) for x in lines], ["".join(form(x).split()) for x in p]
        pairs = sorted(((lev(y, x, opened) / max(len(x), 1), i, j, lev(y, x, opened)) for i, x in enumerate(G) for j, y in enumerate(P)), key=lambda z: z[:3])
        got, used = {}, set()
        for _, i, j, d in pairs:
            if i not in got and j not in used:
                got[i] = (j, d)
                used.add(j)
        c = dict.fromkeys(scoring.COUNTERS, 0)
        c["crops"], c["empty"], whole = 1, int(not pred.get(k, "").strip()), "".join(form(pred.get(k, "")).split())
        for i, x in enumerate(G):
            j, d = got.get(i, (None, len(x)))
            gw, pw = form(lines[i]).split(), form(p[j]).split() if j is not None else []
            for name, n in (("lines", 1), ("letters", len(x)), ("edits", d), ("exact", j is not None and x and d == 0), ("recalled", len(x) > 0 and d < len(x)), ("contained", bool(x) and x in whole), ("words", len(gw)), ("common_words", lcs(pw, gw)), ("word_edits", lev(pw, gw))):
                c[name] += int(bool(n)) if name in ("exact", "recalled", "contained") else n
        if not opened:
            c["extra_edits"] = sum(len(P[j]) for j in range(len(P)) if j not in used)
            c["extra_words"] = sum(len(form(p[j]).split()) for j in range(len(P)) if j not in used)
        want[k] = c
    mk = lambda d: spark.createDataFrame(list(d.items()), "image_name string, text string")
    rows = scoring.crop_counters(mk(gt), mk(pred), "image_name").collect()
    assert {r["image_name"]: {c: r[c] for c in scoring.COUNTERS} for r in rows} == want


def test_false_positives_and_limits(spark):
    """A false positive reports the best truth that was free at its turn; a round limit that is reached is an error."""
    from glyphmill.operators import matching

    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    truth = spark.createDataFrame([("p", "g", (0.0, 0.0, 10.0, 10.0))], f"key string, b string, box {box}")
    pred = spark.createDataFrame([("p", "A", (6.0, 0.0, 16.0, 10.0), 0.9), ("p", "B", (2.0, 0.0, 12.0, 10.0), 0.5)], f"key string, a string, box {box}, conf double")
    got = {r["a"]: (r["status"], round(r["iou"], 3)) for r in matching.match_boxes(pred, truth, "key", 0.5).collect()}
    assert got == {"A": ("FP", 0.25), "B": ("TP", 0.667)}
    chain = spark.createDataFrame([("p", i, (4.0 * i, 0.0, 4.0 * i + 10, 10.0), "n") for i in range(6)], f"key string, id int, box {box}, by string")
    assert sorted(r["id"] for r in matching.suppress(chain, "key", [F.col("id")], 0.3).collect()) == [0, 2, 4]
    with pytest.raises(RuntimeError):
        matching.suppress(chain, "key", [F.col("id")], 0.3, most_rounds=1)
    pairs = spark.createDataFrame([("p", i, j, abs(i - j) + 0.1 * i) for i in range(6) for j in range(6)], "key string, a int, b int, d double")
    with pytest.raises(RuntimeError):
        matching.greedy_match(pairs, ["key"], [F.col("d")], most_rounds=1)
    by = chain.withColumn("by", F.concat(F.lit("m"), F.col("id").cast("string")))
    assert {r["id"]: r["by"] for r in matching.merge_boxes(by, "key", [F.col("id")], 0.3, "by").collect()} == {0: ["m0", "m1"], 2: ["m2", "m3"], 4: ["m4", "m5"]}


def test_average_precision_101(spark):
    import numpy as np

    rng = random.Random(5)
    rows, want = [], {}
    for g in range(8):
        total, hits = rng.randint(1, 30), []
        left = total
        for i in range(rng.randint(1, 40)):
            hit = left > 0 and rng.random() < 0.5
            left -= hit
            hits.append(hit)
            rows.append((f"g{g}", 1 - i / 100, hit, i, total))
        tp = np.cumsum(hits)
        r, p = np.concatenate([[0], tp / total, [1]]), np.concatenate([[1], tp / np.arange(1, len(hits) + 1), [0]])
        p = np.maximum.accumulate(p[::-1])[::-1]
        want[f"g{g}"] = float(np.trapezoid(np.interp(np.linspace(0, 1, 101), r, p), np.linspace(0, 1, 101)))
    df = spark.createDataFrame(rows, "g string, s double, hit boolean, tie int, total int")
    totals = df.groupBy("g").agg(F.max("total").alias("total"))
    got = {r["g"]: r["ap_101"] for r in metrics.average_precision(df.drop("total"), "g", "s", "hit", "tie", totals).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sources_and_sinks(spark, tmp_path):
    photos = spark.createDataFrame([("a", 100, 50), ("b", 10, 10)], "photo string, w int, h int")
    got = {r["photo"]: r["box"] for r in readers.yolo_labels(spark.createDataFrame([("a", "0 0.5 0.5 0.2 0.4")], "photo string, value string"), photos).collect()}
    assert got["b"] is None and tuple(got["a"]) == (40, 15, 60, 35)
    df = spark.createDataFrame([(f"i{i:03d}", f"t{i}", "train" if i % 3 else "val") for i in range(50)], "image_path string, text string, split string")
    readers.numbered_samples(df.repartition(5), "image_path", "text", str(tmp_path / "kv"))
    kv = {r["key"]: r["value"] for r in spark.read.parquet(str(tmp_path / "kv")).collect()}
    assert kv["num-samples"] == "50" and all(kv[f"image-{n + 1:09d}"] == f"i{n:03d}" and kv[f"label-{n + 1:09d}"] == f"t{n}" for n in range(50))
    readers.write_manifest(df, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).where("split = 'val'").count() == 17
    for i in range(2):
        readers.append_rows(df.limit(2), str(tmp_path / "a"))
    assert readers.read_csv(spark, str(tmp_path / "a")).count() == 4
    readers.write_metrics(spark.createDataFrame([("x", 1 / 3)], "e string, cer double"), str(tmp_path / "s"))
    assert readers.read_csv(spark, str(tmp_path / "s")).collect()[0]["cer"] == "0.3333"
    (tmp_path / "k.csv").write_bytes("상호명,위도,경도\n가게,37.5,127.0\n나쁨,x,1\n".encode("cp949"))
    regions = spark.createDataFrame([("r", 37.0, 38.0, 126.0, 128.0)], "region string, lat0 double, lat1 double, lon0 double, lon1 double")
    assert [tuple(r) for r in readers.shops(readers.probed_csv(spark, str(tmp_path / "k.csv")), regions).select("name", "region").collect()] == [("가게", "r")]
    (tmp_path / "l.csv").write_text("a,b\n1,2\n")
    assert readers.concat(spark, [str(tmp_path / "k.csv"), str(tmp_path / "l.csv")]).count() == 3
    rows, unmapped = readers.paged(spark.createDataFrame([('[{"n": "A", "c": "Coffee Shop"}, {"n": "B", "c": "Odd"}, {"c": "x"}]',)], "value string"), "n", "c", [("coffee", "amenity=cafe")])
    assert {(r["name"], r["tag"]) for r in rows.collect()} == {("A", "amenity=cafe"), ("B", "")} and unmapped.collect()[0]["category"] == "Odd"
    shapes = spark.createDataFrame([("p", '{"shapes": [{"label": "sign", "points": [[0, 0], [9, 9]]}, {"label": "sign", "points": [[0, 0], [1, 9]]}, {"label": "x", "points": [[0, 0], [9, 9]]}]}')], "photo string, value string")
    assert readers.polygons(shapes, ["sign"]).count() == 1
    assert one(spark, readers.flexible_box(F.lit('"[1, 2, 3, 4]"')), readers.flexible_box(F.lit("[1, 2, 3, 4]")))[0:2] == ([1, 2, 3, 4], [1, 2, 3, 4])
    rows = spark.createDataFrame([("k", "a", "1")], "id string, tag string, eval_tag string")
    d = spark.createDataFrame([("k", "b", None)], "id string, new_tag string, new_eval string")
    assert labels.apply_checked(rows, rows.select("id"), d, "id").collect()[0]["tag"] == "b"
    with pytest.raises(ValueError):
        labels.apply_checked(rows, rows.select("id"), d.limit(0), "id")
    q = one(spark, g.pad_quad(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))]), 0.2, F.lit(11), F.lit(50)))[0]
    assert [(p["x"], p["y"]) for p in q] == [(0, 0), (10, 0), (10, 11), (0, 11)]


def test_components_end_in_one_task(spark, monkeypatch):
    cuts = []
    real = components.cut
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(1) or real(df))
    rng = random.Random(3)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(300)]
    e = spark.createDataFrame(pairs, "a long, b long")
    up = {n: n for p in pairs for n in p}
    for _ in range(400):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    want = {(n, c) for n, c in up.items()}
    assert {tuple(r) for r in components.components(e).collect()} == want and len(cuts) <= 3
    assert {tuple(r) for r in components.components(e, few=0).collect()} == want
    assert {tuple(r) for r in components.components(e, few=40).collect()} == want


def test_groups_keep_regions(spark):
    i = spark.createDataFrame([("s", "p1", "k"), ("s", "p2", "k"), ("s", "p2", "m"), ("s", "p3", "m"), ("t", "p3", "k"), ("t", "p4", None), (None, "p5", "k"), ("s", None, "k")], "region string, photo string, name string")
    got = {(r["region"], r["photo"]): r["group_id"] for r in folds.shared_groups(i, "photo", "region", "name").collect()}
    assert got == {("s", "p1"): "p1", ("s", "p2"): "p1", ("s", "p3"): "p1", ("t", "p3"): "p3", ("t", "p4"): "p4", (None, "p5"): "p5"}


def _dense(spark, seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice(["p", "q", "p", None]), f"{rng.randint(0, 10**6):07d}{i:03d}", rng.randint(0, 400), rng.randint(0, 250), rng.choice([0, 20, 60, 350]), rng.randint(5, 40), rng.choice([None, 0.1, 0.5, 0.9])) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, id string, x int, y int, w int, h int, conf double").withColumn("box", g.xywh_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    return df.where("id % 3 <> 0").select("key", F.col("id").alias("a"), "box", "conf"), df.where("id % 3 = 0").select("key", F.col("id").alias("b"), "box")


def test_matching_writes_no_pairs(spark, monkeypatch):
    pred, truth = _dense(spark, 5)
    rows = lambda few: sorted(tuple("" if v is None else repr(v) for v in r) for r in matching.match_boxes(pred, truth, "key", 0.1, few=few).collect())
    want = rows(0)  # rounds of joins
    assert {r[5] for r in want} == {"'TP'", "'FP'", "'FN'"} and rows(200) == want
    monkeypatch.setattr(matching, "overlap_join", lambda *a: pytest.fail("all pairs were joined"))
    assert matching.match_boxes(pred, truth, "key", 0.1).count() == len(want)
    monkeypatch.undo()
    assert rows(10**6) == want


def test_large_photos_in_tiles(spark, monkeypatch):
    """a photo of more boxes than a task holds was matched by a table of all its pairs."""
    rng = random.Random(6)
    box = lambda: (x := rng.randint(-300, 700), y := rng.randint(-200, 500), x + rng.choice([0, 10, 40, 150, 900]), y + rng.randint(5, 60))
    preds = [("p", f"{i:04d}", *box(), rng.choice([None, 0.1, 0.5, 0.9])) for i in range(700)] + [("q", "0007", *box(), 0.3), ("q", None, *box(), 0.4)]
    preds += [("p", a, *box(), c) for _, a, *_, c in rng.sample(preds[:700], 60)]  # predictions of two boxes
    truths = [("p", f"{i:04d}", *box()) for i in range(350)] + [("q", "0001", *box()), ("q", "0002", 0, 0, None, 9), ("q", None, *box())]
    iou = lambda a, b: (i := max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))) / max(1, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)
    pairs = [(c is not None, -(c or 0), a, -o, b, k) for k, a, *u, c in preds if a for l, b, *v in truths if k == l and b and None not in v and (o := iou(u, v)) > 0]
    got_a, got_b = {}, {}
    for *turn, a, o, b, k in sorted(p for p in pairs if -p[3] >= 0.1):
        if (k, a) not in got_a and (k, b) not in got_b:
            got_a[k, a], got_b[k, b] = (b, -o), (turn, a)
    best = lambda k, a: max([0.0, *(-o for *turn, x, o, b, l in pairs if (l, x) == (k, a) and ((k, b) not in got_b or (turn, a) < got_b[k, b]))])
    want = [(k, a, b, o, "TP") for (k, a), (b, o) in got_a.items()] + [(k, a, None, best(k, a), "FP") for k, a, *_ in preds if (k, a) not in got_a] + [(k, None, b, 0.0, "FN") for k, b, *_ in truths if (k, b) not in got_b]
    monkeypatch.setattr(matching, "overlap_join", lambda *a: pytest.fail("all pairs were joined"))
    df = lambda rows, i, more="": spark.createDataFrame(rows, f"key string, {i} string, x0 double, y0 double, x1 double, y1 double{more}").select("key", i, F.struct("x0", "y0", "x1", "y1").alias("box"), *(["conf"] if more else []))
    real = lambda rows: [tuple(float(v) if isinstance(v, int) else v for v in r) for r in rows]
    pred, truth = df(real(preds), "a", ", conf double"), df(real(truths), "b")
    flat = lambda rows: sorted(tuple("" if v is None else f"{v:.9f}" if isinstance(v, float) else v for v in r) for r in rows)
    for few, side in ((0, 16.0), (0, 128.0), (100, 32.0), (10**6, 128.0)):
        monkeypatch.setattr(matching, "SIDE", side, raising=False)
        got = matching.match_boxes(pred, truth, "key", 0.1, few=few).select("key", "a", "b", "iou", "status")
        assert flat(tuple(r) for r in got.collect()) == flat(want)


def test_whole_groups_and_blocks():
    import numpy as np
    import pyarrow as pa
    from glyphmill.operators import whole

    keys = [None, None, "a", "b", "b", "b", "c"]
    for size in (1, 2, 3, 7):
        t = pa.table({"k": pa.array(keys, pa.string())})
        got = [x.column("k").to_pylist() for x in whole.whole_groups(iter(t.to_batches(max_chunksize=size)), ["k"])]
        assert sum(got, []) == keys and sum(len(set(x)) for x in got) == 4
    rng = np.random.default_rng(2)
    lo = rng.integers(0, 300, (2, 500)).astype(float)
    box = np.concatenate([lo, lo + rng.integers(1, 60, (2, 500))])
    box[2, :3] += 1000
    group = np.sort(rng.integers(0, 3, 500))
    a, b = np.arange(0, 500, 2), np.arange(1, 500, 2)
    want = {(i, j) for i in range(250) for j in range(250) if group[a[i]] == group[b[j]] and all(min(box[d + 2, a[i]], box[d + 2, b[j]]) > max(box[d, a[i]], box[d, b[j]]) for d in (0, 1))}
    for block in (1, 100, 10**6):
        got = [(int(x), int(y)) for i, j, _ in whole.overlaps(group[a], box[:, a], np.arange(250) // 2, group[b], box[:, b], block) for x, y in zip(i, j)]
        assert len(got) == len(want) and set(got) == want


def test_word_rows_of_dense_lines(spark, monkeypatch):
    from glyphmill.operators import whole

    pred, truth = _dense(spark, 9)
    words = pred.select("key", F.col("a").cast("bigint").alias("id"), "box")
    on = matching.overlap_join(words.select("key", F.col("id").alias("a"), "box"), truth, "key").join(words.withColumnRenamed("id", "a"), ["key", "a"])
    p = F.struct(((F.col("box.y0") + F.col("box.y1")) / 2).alias("y"), F.col("box.x0").alias("x"), F.col("a").alias("id"))
    per = on.groupBy("key", "b").agg(F.collect_list(p).alias("p"), F.avg(F.col("box.y1") - F.col("box.y0")).alias("h"))
    rows = matching.group_lines(F.col("p"), F.col("h") * 0.2)
    want = {(r["key"], r["b"], r["rows"], r["words"], r["order"]) for r in per.select("key", "b", F.size(rows).alias("rows"), F.size("p").alias("words"), F.array_join(F.transform(F.flatten(rows), lambda i: i.cast("string")), " ").alias("order")).collect()}
    assert max(r[2] for r in want) > 2
    monkeypatch.setattr(matching, "overlap_join", lambda *a: pytest.fail("all pairs were joined"))
    for few in (20, 10**6):
        got = [tuple(r) for r in matching.word_rows(words, truth, "key", 0.2, few).select("key", "b", "rows", "words", "order").collect()]
        assert len(got) == len(want) and set(got) == want
    assert whole.rows_of(*[__import__("numpy").array(v, float if k in (0, 3) else int) for k, v in enumerate(([1, 2, 9, 5, 5.5], [0, 3], [3, 2], [2.0, 0.1]))]).tolist() == [0, 0, 1, 0, 1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["greedy_box_match", "legacy_match", "match_then_ap"])
def test_queries_write_no_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(matching, "overlap_join", lambda *a: pytest.fail("all pairs were joined"))
    assert registry.queries()[name](spark, SF).count() > 0
