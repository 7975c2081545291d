"""Small cases of the training-data operators: nulls, empties, long texts, ties, repeats, clashing columns, brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import canonical_values, cross_split, grouped_splits, lookalikes, mixing, name_variants, packing, template_residue

MANIFEST = "annotation_id string, text string, split string, source_image string, source_image_id string, component string, node string, _id int"
DOCS = "doc_id long, text string, source string, tokens int, slot long, uses int"


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def manifest(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], MANIFEST)


def test_p1_groups_and_torn(spark):
    rows = [
        ("1", "a", "train", "street_1.jpg", "400000001"), ("2", "a", "VAL", r"D:\x\STREET_1.JPG", None), ("3", "b", "train", "street_1_copy.jpg", "id:400,000,002"),
        ("4", "c", None, "street_9.jpg", "0400000009.0"), ("5", "c", "test", "street_9 (1).jpeg?v=2", " 400000009"), ("6", None, "train", None, None), ("6", None, "train", None, None),
    ]
    m = manifest(spark, rows)
    assert {r[0] for r in grouped_splits.torn_photos(m).collect()} == {400000001, 400000002}
    targets = spark.createDataFrame([("train", 0.5), ("val", 0.25), ("test", 0.25)], "split string, share double")
    a = {r["annotation_id"]: (r["group_id"], r["new_split"]) for r in grouped_splits.assign_splits(m, targets).collect()}
    assert len(a) == 6 and a["1"] == a["2"] == a["3"] and a["4"] == a["5"] and all(s for _, s in a.values())
    assert grouped_splits.torn_photos(m.limit(0)).count() == 0
    assert grouped_splits.assign_splits(m.limit(0), targets).count() == 0
    assert sum(r["records"] for r in grouped_splits.split_shares(grouped_splits.assign_splits(m, targets), targets).collect()) == 6


def test_p1_subset_sums():
    rng = random.Random(3)
    for _ in range(30):
        sizes = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(5)}
        total = sum(s * n for s, n in sizes.items())
        plan = grouped_splits.choose_counts(sizes, [("train", 0.8), ("val", 0.1), ("test", 0.1)])
        assert all(sum(p.get(s, 0) for p in plan.values()) == n for s, n in sizes.items())
        sums = {sum(s * k for s, k in zip(sizes, ks)) for ks in itertools.product(*[range(n + 1) for n in sizes.values()])}
        goal = round(0.1 * total)
        first = sum(s * n for s, n in plan["test"].items())
        assert abs(first - goal) == min(abs(x - goal) for x in sums)
    assert grouped_splits.choose_counts({3: 1}, []) == {}


def padded(spark, rows):
    """Rows with a corpus around them that shows which words are common."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)) + rng.choice("xzq")
    ko = lambda: "".join(rng.choice("가나다라마바사아자차카타파하거너더러머버고노도로모보") for _ in range(4))
    more = [(f"z{k}{i}", f"{word()} {word()} {k}") for k in ("Kitchen", "Kitch.", "Margaret", "Maggie", "Coffee", "Cafe", "Hair", "Pizza") for i in range(14)]
    more += [(f"z{k}{i}", f"{ko()} {ko()} {k}") for k in ("식당", "한식당", "카페") for i in range(14)]
    return spark.createDataFrame([(*r, "k", "n") for r in [*rows, *more]], "image_name string, name string, node string, kind string")


def test_p2_names(spark):
    rows = [
        ("a1", "Margaret Tirenigix Babrabradar Kitchen"), ("a2", "MAGGIE TIRENIGIX + BABRABRADAR KITCH."), ("a3", "Babrabradar, Tirenigx Kitchen"), ("a4", "Tireni. Babrabradar"),
        ("b1", "Margaret Tirenigix Wopulador Kitchen"), ("c1", "가나다라 마바사아 식당"), ("c2", "가나다라마바사아식당"), ("c3", "한식당 마바사아 가나타라"), ("d1", "가나다라 자차카파 식당"),
        ("e1", None), ("e2", " "), ("f1", "Cafe"), ("f2", "cafe"), ("g1", "Жалюзи Вяндо"), ("a1", "Margaret Tirenigix Babrabradar Kitchen"), ("h1", "x" * 20000), ("h2", "가나다" * 3000), ("h3", "가나다" * 3000 + "라"),
    ]
    df = padded(spark, rows)
    got = {tuple(r) for r in name_variants.same_business_pairs(df).collect()}
    want = set(itertools.combinations(["a1", "a2", "a3", "a4"], 2)) | set(itertools.combinations(["c1", "c2", "c3"], 2)) | {("f1", "f2"), ("h2", "h3")}
    assert got == want
    assert name_variants.same_business_pairs(df.limit(0)).count() == 0


def brute_slips(a, b):
    """Edits with a swap of neighbours as one, each letter touched once."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_p2_slips(spark):
    """All pairs within the slips are taken, and none with more edits than swaps could stand for."""
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in "ab") for _ in range(400)] + [("abcd", "acbd"), ("abcdefgh", "badcefgh")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2):
        got = {(r["a"], r["b"]) for r in df.where(name_variants.within(F.col("a"), F.col("b"), most)).collect()}
        assert {p for p in pairs if brute_slips(*p) <= most} <= got
        assert all(brute_edits(*p) <= 2 * most for p in got)


def test_p3_forms(spark):
    t = lookalikes.Transducer()
    cases = {
        "Ｇｒｉｌｌ": "Grill", "Cafe\u0301": "Café", "\u1100\u1161\u11a8": "각", "a\u200bb\u00a0c": "ab c", "\u039aIT\u0421HEN": "KITCHEN", "\u212aitchen": "Kitchen", "A\\n\u0416\u0430": "A\\n\u0416\u0430",
        "ﬁne": "fine", "Ⓒafe": "Cafe", "Ꮯafe": "Cafe", "ᏣᎳᎩ": "ᏣᎳᎩ",
        "Жалюзи": "Жалюзи", "Ωλδίφος": "Ωλδίφος", "Piñaro": "Piñaro", "雲山茶舗": "雲山茶舗", "": "", "ㅁㄴㅇㄹ": "ㅁㄴㅇㄹ", "\U0001f468\u200d\U0001f469": "\U0001f468\u200d\U0001f469",
    }
    for x, y in cases.items():
        assert t(x) == y and t(y) == y
    long = "가\u200b나 " * 50000
    df = spark.createDataFrame([("a", "Ａ", 1), ("b", None, 1), ("c", "", 1), ("d", long, 1), ("d", long, 1)], "image_name string, name string, form int")
    got = [tuple(r) for r in lookalikes.consistent_forms(df, "image_name", "name").select("image_name", "changed").collect()]
    assert sorted(got) == [("a", True), ("b", False), ("c", False), ("d", True), ("d", True)]


def test_p5_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("가나다라마바사아자차카타파하") for _ in range(rng.randint(14, 30))) for _ in range(60)]
    rows = []
    for i, b in enumerate(base):
        rows.append((f"t{i}", b, "train", "p", "1"))
        c = list(b)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(c))
            c[k : k + 1] = rng.choice([[], ["z"], [c[k], "y"]])
        rows.append((f"e{i}", " ".join(c).upper() + "!", rng.choice(["val", "Test"]), None, "1"))
    rows += [("n1", None, "train", None, None), ("n2", base[0], None, None, None), ("n3", "short", "val", None, None), ("t0", base[0], "train", "p", "1"), ("L1", "q" * 50000, "train", None, None), ("L2", "q" * 50001, "val", None, None)]
    m = manifest(spark, rows)
    got = {(r["train_record"], r["eval_record"]) for r in cross_split.overlaps(m).collect()}
    plain = {r[0]: "".join(c for c in (r[1] or "").lower() if c.isalnum()) for r in rows}
    tr, ev = ({r[0] for r in rows if (r[2] or "").lower() in s} for s in (("train",), ("val", "test")))
    want = {(a, b) for a in tr for b in ev if min(len(plain[a]), len(plain[b])) >= 14 and len(plain[a]) < 1000 > len(plain[b]) and brute_edits(plain[a], plain[b]) <= 3} | {("L1", "L2")}
    assert got == want
    assert cross_split.overlap_report(m.limit(0)).count() == 0
    assert sum(r["pairs"] for r in cross_split.overlap_report(m).collect()) == len(want)


def test_p6_values(spark):
    voc = spark.createDataFrame([("amenity=cafe", "Cafe", "카페"), ("amenity=restaurant", "Restaurant", "음식점"), ("amenity=bar", "Bar", "술집"), ("shop=hardware", "Hardware", None)], "tag string, label string, label_ko string")
    cases = {
        "Cafe": "amenity=cafe", "amenity：cafe": "amenity=cafe", "shop = RESTAURANT": "amenity=restaurant", "rsetaurnat": "amenity=restaurant", "a bar": "amenity=bar", "bars": "amenity=bar", "점집": "unmatched", "술집 ": "amenity=bar",
        "tea_room": "unmatched", "zzz": "unmatched", "x" * 100000: "unmatched", "[음식점]": "amenity=restaurant", "shop=aquarium": "unmatched", "haredware": "shop=hardware",
    }
    rows = [(f"i{k}", v, "m") for k, v in enumerate(cases)] + [("n", None, "m"), ("b", " ", "m"), ("u", "unknown", "m"), ("l", "amenity=bar", "m"), ("i0", "Cafe", "m")]
    df = spark.createDataFrame(rows, "image_name string, tag string, mapped_tag string")
    got = {r[0]: r[1] for r in canonical_values.mapped_records(df, voc).collect()}
    assert got == {f"i{k}": v for k, v in enumerate(cases.values())}
    assert canonical_values.mapped_records(df.limit(0), voc).count() == 0
    assert {r[1] for r in canonical_values.mapped_records(df.where("image_name = 'i0'"), voc.limit(0)).collect()} == {"unmatched"}
    assert canonical_values.unmatched_values(df, voc).count() == 5


def test_p6_words_learned_from_names(spark):
    """A word the list lacks means the tag that the names of its records vote for; mixed names make no word."""
    voc = spark.createDataFrame([("amenity=cafe", "Cafe", None), ("amenity=bar", "Bar", None)], "tag string, label string, label_ko string")
    rows = [(f"a{i}", "amenity=cafe", f"{'abcdefgh'[i]}xo Coffee") for i in range(8)] + [(f"b{i}", "Bar", f"{'abcdefgh'[i]}yo Tavern") for i in range(8)]
    rows += [(f"c{i}", t, "Qo Coffee") for i, t in enumerate(["tea room", "Tea Room", "amenity=tea_room", "tea-room", "tea roon"])]
    rows += [(f"d{i}", "kiosk", n) for i, n in enumerate(["Zo Coffee", "Zo Tavern", "Yo Coffee", "Yo Tavern", "Xo Coffee", "Xo Tavern"])] + [("e", "teahouse", "Wo Coffee"), ("n", "tea room", None), ("b", None, "Qo Coffee")]
    got = {r[0]: r[1] for r in canonical_values.mapped_records(spark.createDataFrame(rows, "image_name string, tag string, name string"), voc).collect()}
    assert {k: got[k] for k in got if k[0] in "cden"} == {**{f"c{i}": "amenity=cafe" for i in range(5)}, **{f"d{i}": "unmatched" for i in range(6)}, "e": "unmatched", "n": "amenity=cafe"}


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS)


def test_p7_packing(spark):
    rows = [(i, "word " * (i % 37), "s") for i in range(200)] + [(900, None, "s"), (901, "", "s"), (902, "long text " * 900, "s"), (1, "word ", "s"), (None, "x", "s"), (903, "a" * 20000, "s")]
    d = docs(spark, rows)
    c = spark.createDataFrame([("small", 50), ("big", 400), ("bad", None)], "container string, capacity_tokens int")
    p = packing.pack(d, c).toPandas()
    for name, cap in (("small", 50), ("big", 400)):
        q = p[p.container == name]
        assert q.doc_id.nunique() == 204 and q.groupby("bin").tokens.sum().max() <= cap
        whole = q.groupby("doc_id").agg(n=("piece", "size"), t=("tokens", "sum"))
        assert ((whole.n == 1) | (whole.t > cap)).all() and not q.duplicated(["doc_id", "piece"]).any()
    r = {x["container"]: x for x in packing.fill_report(packing.pack(d, c), c).collect()}
    assert r["big"]["bins"] <= r["big"]["least_bins"] + 1
    assert packing.pack(d.limit(0), c).count() == 0 and packing.pack(d, c.limit(0)).count() == 0


def test_p7_best_fit_serves_all():
    rng = random.Random(2)
    for _ in range(50):
        sizes = {rng.randint(1, 30): rng.randint(1, 50) for _ in range(8)}
        moves, opened = packing.best_fit(sizes, 30)
        load = {}
        for size, _, first, n in moves:
            for b in range(first, first + n):
                load[b] = load.get(b, 0) + size
        assert max(load.values()) <= 30 and len(load) == opened
        for s, n in sizes.items():
            ranks = sorted(r for size, r0, _, k in moves if size == s for r in range(r0, r0 + k))
            assert ranks == list(range(1, n + 1))


def test_p8_mixing(spark):
    rows = [(i, "some words here " * (1 + i % 5), "big") for i in range(400)] + [(1000 + i, "few words", "small") for i in range(20)] + [(2000, None, "small"), (2001, "x", None), (2002, "y", "other"), (5, "some words here ", "big")]
    t = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("none", 0.1, None)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(docs(spark, rows), t)
    s = {r["source"]: r for r in shares.collect()}
    assert s["none"]["share"] == 0 and abs(s["big"]["share"] - 0.8) < 0.02 and s["small"]["most_uses"] == 3 and s["big"]["most_uses"] == 1
    assert {r["source"] for r in drawn.collect()} == {"big", "small"}
    drawn, shares = mixing.mix(docs(spark, rows), t, total=1e9)
    assert {r["source"]: r["most_uses"] for r in shares.collect()}["small"] <= 3
    assert mixing.mix(docs(spark, rows).limit(0), t)[0].count() == 0 and mixing.mix(docs(spark, rows), t.limit(0))[1].count() == 0
    hot = {r["source"]: r for r in mixing.mix(docs(spark, rows), t, total="corpus")[1].collect()}
    assert hot["small"]["exponent"] < 1 and hot["small"]["most_uses"] <= 3 and sum(r["tokens"] for r in hot.values()) > 0.9 * sum(3 * (1 + i % 5) for i in range(400))
    even = {r["source"]: r for r in mixing.mix(docs(spark, rows), t, target_entropy=0.69)[1].collect()}
    assert even["big"]["exponent"] < 0.2 and abs(even["big"]["share"] - even["small"]["share"]) < 0.2
    x = mixing.exponent_for_entropy([0.7, 0.2, 0.1], 1.0)
    assert mixing.entropy(mixing.tempered([0.7, 0.2, 0.1], x)) == pytest.approx(1.0, abs=1e-6)


def test_p9_residue(spark):
    natural = [f"Crop {i} shows the bakery next to a plate for the hotel. The sign was painted by hand in {1900 + i}. The upload tool answered \"page not found\" twice." for i in range(300)]
    bad = {
        1000: "Dear {{ owner }}, thank you for the photo.", 1001: "Lorem ipsum dolor sit amet consectetur. Sed eiusmod tempor magna.", 1002: natural[3] + "\nYou need to enable JavaScript to continue.",
        1003: "오류 404\n요청하신 페이지를 찾을 수 없습니다.", 1004: "검수: [전화번호을 입력하세요]", 1005: "x {{name}} " * 20000,
        1006: "Seen by *|REVIEWER|*.", 1007: "$OWNER$ 근처에서 찍었다.", 1008: "검수: «owner» 간판은 낮다.", 1009: "왼쪽 판에서 __SHOP_NAME__까지 읽었다.", 1010: "Ask $PHONE first.",
    }
    fine = {2000: None, 2001: "", 2002: 'The engine gave {"name": "Bar", "tag": "shop=books"} and the set {red, blue}.', 2005: "El rótulo «Casa Pepe» cuesta $20 y 5$ más; US$ALE.", 2003: "The third word is [illegible] (see photo 3) <3.", 2004: natural[0] * 500}
    rows = [(i, t, "s") for i, t in enumerate(natural)] + [(k, v, "s") for k, v in [*bad.items(), *fine.items(), (1000, bad[1000])]]
    got = {r["doc_id"] for r in template_residue.residue(docs(spark, rows)).where("found").collect()}
    assert got == set(bad)
    assert template_residue.residue(docs(spark, rows).limit(0)).count() == 0


def test_p9_short_pieces(spark):
    natural = [f"Crop {i} shows the bakery next to a plate for the hotel. Open. The sign was painted by hand in {1900 + i}. 둘째 줄. 간판은 {i}번 사진에 있다. 第{i}张图。 旧字还在。" for i in range(300)]
    bad = {1000: "服务暂时不可用。 请稍后再试。", 1001: "견본 글입니다. 견본 글입니다.", 1002: "拒绝访问。", 1003: natural[5] + "\n请稍后再试。", 1004: "오류 404\n拒绝访问。"}
    fine = {2000: "Open", 2001: "둘째 줄.", 2002: "旧字还在。 第7张图。", 2003: natural[9] + "\nOpen"}
    rows = [(i, t, "s") for i, t in enumerate(natural)] + [(k, v, "s") for k, v in [*bad.items(), *fine.items()]]
    got = {r["doc_id"]: r["coverage"] for r in template_residue.residue(docs(spark, rows)).where("found").collect()}
    assert set(got) == set(bad)
    assert got[1000] == got[1001] == 1


def test_p2_cosine_join_brute_force(spark):
    """The index loses no pair: short and long strings of all kinds against a comparison of all pairs."""
    rng = random.Random(7)

    def slip(s, letters):
        i = rng.randrange(len(s))
        return rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i:], s[:i] + rng.choice(letters) + s[i + 1 :], s[:i] + s[i + 1 : i + 2] + s[i] + s[i + 2 :]])

    ko, la = "가나다라마바사아자차카타파하거너더러머버", "abcdefghiklmnoprstuv"
    rows = set()
    for n in [2, 3, 4] * 8:
        own = "".join(rng.choice(ko) for _ in range(n))
        rows |= {("one", x) for x in (own, slip(own, ko) or own)}
    for n in [5, 6, 7, 8, 9, 12, 13, 16, 20, 40, 60] * 6:
        own = "".join(rng.choice(ko) for _ in range(n))
        rows |= {("ko", x) for x in (own, slip(own, ko), slip(slip(own, ko), ko), slip(own[n // 2 :] + own[: n // 2], ko))}
    for n in [4, 5, 6, 7, 8, 11, 14, 17, 70] * 12:
        own = "".join(rng.choice(la) for _ in range(n))
        rows |= {("la", x) for x in (own, own[: rng.randint(3, 14)] + ".", slip(own[:6], la) + ".", slip(own, la), slip(slip(own, la), la))} | {("one", own), ("one", slip(own, la))}
    df = spark.createDataFrame(sorted(rows), "kind string, s string").cache()
    got = {(r["kind"], r["a"], r["b"]): r["sim"] for r in name_variants.cosine_join(df).collect()}
    v = name_variants.vectors(df).cache()
    mine = lambda x: v.select("kind", F.col("s").alias(x), F.col("v").alias(f"v{x}"), F.col("norm").alias(f"n{x}"))
    every = mine("a").join(mine("b"), "kind").where("a <> b").where(name_variants.close(F.col("kind"), F.col("a"), F.col("b")))
    want = {}
    for r in every.collect():
        a, b = {x["g"]: x["w"] for x in r["va"]}, {x["g"]: x["w"] for x in r["vb"]}
        sim = sum(w * b[g] for g, w in a.items() if g in b) / r["na"] / r["nb"]
        if abs(sim - name_variants.COSINE) > 1e-9 and sim >= name_variants.COSINE:
            want[r["kind"], r["a"], r["b"]] = sim
    assert len(want) > 300 and {k for k, _, _ in want} == {"ko", "la", "one"} and set(want) == set(got)
    assert all(abs(got[k] - x) < 1e-9 for k, x in want.items())
    assert max(len(b) for _, b, _ in want) > 48


def test_p2_one_word_and_short_names(spark):
    rows = [
        ("a1", "Starbucks Coffee"), ("a2", "Starbuks Coffee"), ("b1", "스타벅스 카페"), ("b2", "스타박스"), ("c1", "Kim Hair"), ("c2", "Kim Pizza"), ("c3", "Kin Hair"), ("c4", "KIM, HAIR"),
        ("d1", "삼미 식당"), ("d2", "삼마 식당"), ("e1", "Starling Coffee"), ("f1", "Babrabradar"), ("f2", "Babrabradar Tirenigix"),
    ]
    got = {tuple(r) for r in name_variants.same_business_pairs(padded(spark, rows)).collect()}
    assert got == {("a1", "a2"), ("b1", "b2"), ("c1", "c4")}


def test_p1_shares_of_many_records():
    """Over 4 million records small groups count as what they are, large ones still fit."""
    shares = [("train", 0.8), ("val", 0.1), ("test", 0.1)]
    for sizes in ({1: 12_000_000}, {1: 9_000_000, 3: 1_000_000, 1_700_001: 1}, {7: 4_000_000, 90: 1_000_000, 12_000: 300}, {1: 900_000_000, 40: 5_000_000, 300_000_000: 1}):
        total = sum(s * n for s, n in sizes.items())
        plan = grouped_splits.choose_counts(sizes, shares)
        assert all(sum(p.get(s, 0) for p in plan.values()) == n and min(p.get(s, 0) for p in plan.values()) >= 0 for s, n in sizes.items())
        for name in ("val", "test"):
            assert abs(sum(s * n for s, n in plan[name].items()) - round(0.1 * total)) <= 1
    assert grouped_splits.choose_counts({3_000_000: 1, 2_000_000: 20, 1_000_000: 2}, [("a", 0.5), ("b", 0.5)])["b"]
    plan = grouped_splits.choose_counts({50_000_000: 3, 5_000_000: 1}, shares)  # only whole large groups: the nearest is taken
    assert plan["test"] == {5_000_000: 1} and plan["val"] == {}


#: Wordings held out: written once, in none of the lists, never used to choose a sentence or a threshold.
HELD_OUT = [
    "We are sorry, but the page you are looking for has moved or no longer exists.", "The web server reported a bad gateway error.", "Your request could not be processed at this time. Please come back later.",
    "Sign in to view this content.", "This content is not available in your region.", "An unexpected error occurred while loading the page.", "Please turn on JavaScript in your browser settings to use this site.",
    "This application requires scripts to be enabled.", "Connection timed out while contacting the server.", "You are not authorized to access this resource.", "Replace this text with your own description.",
    "Lorem ipsum dolor sit amet, sed diam nonummy nibh euismod.", "Type your description here.", "This is a sample paragraph that you should replace.", "페이지가 삭제되었거나 주소가 변경되었습니다.", "서버에 일시적인 문제가 발생했습니다. 나중에 다시 시도해 주세요.",
    "로그인 후 이용하실 수 있습니다.", "브라우저에서 자바스크립트를 활성화해 주세요.", "여기에 내용을 입력하세요.", "이 문장은 예시이므로 교체해 주세요.", "La página que busca no está disponible.", "Se produjo un error en el servidor. Inténtelo de nuevo más tarde.",
    "Debe activar JavaScript en su navegador para ver esta página.", "Sustituya este texto por su descripción.", "您访问的页面已被删除。", "服务器发生错误,请稍后重试。", "请在浏览器中开启JavaScript。", "请输入您的内容。", "请登录后继续浏览。", "此处为占位文本,请替换。",
]


def test_p9_held_out_wordings(spark):
    """Notices and filler in wordings that no list holds, alone and behind real sentences; prose about them is none."""
    natural = [f"Crop {i} shows the bakery next to a plate for the hotel. The sign was painted by hand in {1900 + i}. 간판은 {i}번 사진에 있고 글자는 손으로 썼다. El rótulo {i} cuelga sobre la puerta. 第{i}张照片里的招牌是手写的。" for i in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(natural)]
    rows += [(1000 + i, t, "s") for i, t in enumerate(HELD_OUT)] + [(2000 + i, natural[i] + "\n" + t, "s") for i, t in enumerate(HELD_OUT)]
    rows += [(3000, 'The note quoted "{{ owner }}" from the old form.', "s"), (3001, "The owner told us that the page about the shop has been painted over.", "s")]
    got = {r["doc_id"] for r in template_residue.residue(docs(spark, rows)).where("found").collect()}
    assert not {i for i in got if i < 1000 or i >= 3000}
    found = {i % 1000 for i in got if i >= 1000}
    print("held out", len(found), "of", len(HELD_OUT), sorted(set(range(len(HELD_OUT))) - found))
    assert len(found) >= 0.5 * len(HELD_OUT)


def test_p2_index_in_slices(spark, monkeypatch):
    """The index is joined a slice of its keys at a time, with the pairs of the whole."""
    rng = random.Random(5)
    rows = {("la", "".join(rng.choice("abcde") for _ in range(rng.randint(4, 9)))) for _ in range(150)} | {("ko", "".join(rng.choice("가나다라") for _ in range(6))) for _ in range(60)}
    df = spark.createDataFrame(sorted(rows), "kind string, s string")
    cuts = []
    real = name_variants.cut
    monkeypatch.setattr(name_variants, "cut", lambda d: cuts.append(d.columns) or real(d))
    pairs = lambda n: {(r["kind"], r["a"], r["b"], round(r["sim"], 9)) for r in name_variants.cosine_join(df, most_keys=n).collect()}
    want = pairs(10**9)
    assert want and not sum(c[:2] == ["ia", "ib"] for c in cuts)
    assert pairs(1000) == want and sum(c[:2] == ["ia", "ib"] for c in cuts) > 2
