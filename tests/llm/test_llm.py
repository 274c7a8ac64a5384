import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinsieve.llm import addresses, belief, canonical, edit, leakage, names, packing, persons, places, spans, truth

# edit distances and BK-trees


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_levenshtein(a, b):
    assert edit.levenshtein(a, edit.masks(a), b) == lev(a, b)
    assert edit.typo_distance(a, b) <= lev(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=8), max_size=40), st.text("abcd", max_size=8), st.integers(0, 3))
def test_bk_tree_returns_every_entry(words, query, radius):
    want = sorted((lev(query, w), w) for w in set(words) if lev(query, w) <= radius)
    assert edit.BKTree(words).within(query, radius) == want
    assert edit.ShardedBKTree(words).within(query, radius) == want


ENTRIES = [(1, "Cororez Foods LLP", "Foods"), (2, "Orlarcroft Textiles Group", "Textiles"), (3, "Orlarcroft Savings Bank", "Savings Bank"), (4, "Istaphlin Public Schools", "Public Schools"), (5, "Velanault & Thorolley Hospital", "Hospital")]


def test_map_to_reference(frame, spark):
    typed = {
        "COROREZ FOODS": 1, "C0ROREZ": 1, "Corroez Food": 1, "orlarcroft textiles": 2, "Orlarcroft Sav Bank": 3, "ISTAPHLIN P.S.": 4, "Public Schools, Istaphlin": 4, "VTH": 5, "V.T.H.": 5,
        "c/o Velanault and Thorolley Hosp.": 5, "Cororez Bakery": 0, "Cororez Textiles": 0, "RETIRED": 0, "Zimmer Foods": 0, "n/a": 0, "Velanault&ThorolleyHospital": 5, "x" * 5000: 0, "é": 0,
    }
    d = frame("typed string, employer_id0 string", *[(k, None) for k in typed], (None, None), ("  ", None), ("RETIRED", None))
    schema = "employer_id long, employer_name string, industry string"
    listed = frame(schema, *ENTRIES)
    for most in (100, 2):
        # parts of the list give the same as the whole list
        got = canonical.map_to_reference(d, "typed", listed, max_reference=most)
        assert {r.typed: r.employer_id for r in got.collect()} == typed and got.count() == len(typed) + 1
    assert canonical.map_to_reference(spark.createDataFrame([], "typed string"), "typed", listed).count() == 0
    assert canonical.map_to_reference(frame("typed string", "a"), "typed", spark.createDataFrame([], schema)).first().employer_id == 0
    with pytest.raises(ValueError):
        canonical.map_to_reference(d, "typed", listed, max_industries=2)


def test_every_entry_within_the_radius_is_returned(frame):
    # an exact core of one industry does not hide a near one of the industry that was typed
    listed = frame("employer_id long, employer_name string, industry string", (1, "Mororkar Laboratories", "Laboratories"), (2, "Mororkan Steel", "Steel"))
    got = canonical.map_to_reference(frame("typed string", "Mororkam Steel", "Mororkar Steel", "Mororkar Labs", "Mororkar"), "typed", listed)
    assert {r.typed: r.employer_id for r in got.collect()} == {"Mororkam Steel": 2, "Mororkar Steel": 2, "Mororkar Labs": 1, "Mororkar": 1}


# shared spans


def brute_shared(docs, n):
    words, seen = {d: spans.split_units(t, "word") for d, t in docs}, defaultdict(set)
    for d, w in words.items():
        for s in range(len(w) - n + 1):
            seen[tuple(w[s : s + n])].add(d)
    out = set()
    for d, w in words.items():
        cover = [False] * (len(w) + 1)
        for s in range(len(w) - n + 1):
            if len(seen[tuple(w[s : s + n])]) > 1:
                cover[s : s + n] = [True] * n
        start = None
        for i, c in enumerate(cover):
            if c and start is None:
                start = i
            if not c and start is not None:
                out.add((d, start, i - start))
                start = None
    return out


@pytest.mark.parametrize("n", [4, 7])
def test_shared_runs_against_brute_force(frame, n):
    rng = random.Random(n)
    vocabulary, stock = [f"w{i}" for i in range(6)], [[f"p{k}_{i}" for i in range(rng.randint(n - 1, 3 * n))] for k in range(5)]
    docs = []
    for d in range(60):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(stock) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
        docs.append((d, " ".join(w)))
    docs += [(100, ""), (101, None), (102, "x " * 20000), (103, "hot notice " + " ".join(map(str, range(30)))), (104, "hot notice " + " ".join(map(str, range(30))))]
    df = frame("doc_id int, text string, h int", *[(d, t, 0) for d, t in docs])
    got = {(r.doc_id, r.start_unit, r.n_units) for r in spans.stretches(spans.shared_runs(df, "doc_id", "text", n), n).collect()}
    assert got == brute_shared([(d, t) for d, t in docs if t], n)


def test_sentence_runs(frame, spark):
    notice = "One is here. Two is here. Three is here."
    df = frame("doc_id int, text string", (1, f"A start. {notice} An end."), (2, f"{notice} Another."), (3, "Alone. And short."), (4, ""))
    got = {r.doc_id: (r.n_units, r.removed_units, r.kept_text) for r in spans.drop_repeated(df, "doc_id", "text", 3).collect()}
    assert got[1][1] == 0 and got[2][1:] == (3, "Another.") and got[3] == (2, 0, "Alone. And short.") and got[4] == (0, 0, "")
    assert spans.shared_runs(spark.createDataFrame([], "doc_id int, text string"), "doc_id", "text", 3).count() == 0


def test_anchors_cover_every_run():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, 400).astype(np.uint64)
    at, _, k = spans.anchors(x, 10)
    for s in range(len(x) - 9):
        assert any(s <= a and a + k <= s + 10 for a in at)


# leakage


def test_leaks_against_brute_force(frame, spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25)))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for d in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            t = rng.choice(items[:30])[1].split()
            a = rng.randint(0, len(t))
            w += t[a : a + rng.randint(3, 14)]
        docs.append((d, " ".join(w).upper() if d % 2 else ", ".join(w)))
    docs += [(200, None), (201, ""), (202, "w1 " * 30000)]
    want = set()
    for d, t in docs:
        doc = f" {' '.join(leakage.words(t))} "
        for i, u in items:
            w = leakage.words(u)
            if any(f" {' '.join(w[s : s + 6])} " in doc for s in range(len(w) - 5)):
                want.add((d, i))
    df, it = frame("doc_id int, text string", *docs, docs[0]), frame("item_id int, text string", *items)
    got = leakage.find_leaks(df, "doc_id", "text", it, "item_id", "text", span=6, group=7).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    empty = spark.createDataFrame([], "item_id int, text string")
    assert leakage.find_leaks(df, "doc_id", "text", empty, "item_id", "text").count() == 0


# packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    # best fit: no two bins could be one
    fills = sorted(sum(sizes[i] for i in b) for b in bins)
    assert len(fills) < 2 or fills[0] + fills[1] > 50 or fills[0] == 0


def test_pack(frame, spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([5, 30, 70, 120, 260])) for i in range(2000)] + [(9001, 0), (9002, None), (9003, -3), (9004, 1000)]
    out = packing.pack(frame("id int, size int, capacity int", *[(a, b, 1) for a, b in rows]), "id", "size", [(1, 100), (2, 300)])
    got = out.toPandas()
    for cid, cap in ((1, 100), (2, 300)):
        g = got[got.capacity_id == cid]
        assert set(g.item_id) == {r[0] for r in rows} and g.groupby("container_id").piece_size.sum().max() <= cap
        assert g.piece_size.sum() == sum(max(s or 0, 0) for _, s in rows)
        assert (g.groupby("item_id").size() == [max(-(-max(s or 0, 0) // cap), 1) for _, s in sorted(rows)]).all()
        # hardly more containers than one best fit over all items
        pieces = sorted(g.piece_size, reverse=True)
        assert g.container_id.nunique() <= 1.02 * len(packing.best_fit(pieces, cap)) + 1
    assert packing.pack(spark.createDataFrame([], "id int, size int"), "id", "size", [(1, 10)]).count() == 0


def test_small_leaves_waste_no_more(frame):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 160)) for i in range(6000)]
    d, total = frame("id int, size int", *rows), sum(s for _, s in rows)
    for leaf in (300, 200_000):
        got = packing.pack(d, "id", "size", [(1, 1000)], leaf_rows=leaf).toPandas()
        assert sorted(got.item_id) == [i for i, _ in rows] and got.groupby("container_id").piece_size.sum().max() <= 1000
        assert total / (1000 * got.container_id.nunique()) >= 0.99


# truth discovery


def test_truth_with_rank(frame, spark):
    schema = "fp string, id long, src string, conf int, at string, a string, b string, grp string"
    rows = [
        (" X ", 1, "s", 50, "2025-01-01", "old", "n/a", "g"), ("x", 2, "s", 90, "2025-01-01", "-", None, "g"), ("x", 3, "t", 90, "2025-02-01", "new", "", "g"), ("x", 4, "t", 90, "2025-02-01", "tie", "kept", "g"),
        ("x", 5, "t", None, None, "low", "low", "g"), ("alone", 6, "s", 1, None, "v", "v", "g"), ("empty", 7, "s", 1, None, None, " ", "g"), ("empty", 8, "s", 1, None, "TBD", "?", "g"), (None, 9, "s", 1, None, "v", "v", "g"), ("", 10, "s", 1, None, "v", "v", "g"),
        ("x", 4, "t", 90, "2025-02-01", "tie", "kept", "g"),
    ]
    d = frame(schema, *rows)
    rank = [F.coalesce("conf", F.lit(-1)), F.coalesce("at", F.lit(""))]
    got = truth.truth_discovery(d, F.col("fp"), F.col("id"), F.col("src"), {"a": F.col("a"), "b": F.col("b")}, rank)
    assert {(r.grp, r.field_name): (r.row_id, r.value) for r in got.collect()} == {("x", "a"): (3, "new"), ("x", "b"): (4, "kept")}
    none = spark.createDataFrame([], schema)
    assert truth.truth_discovery(none, F.col("fp"), F.col("id"), F.col("src"), {"a": F.col("a")}, rank).count() == 0


def test_a_rank_is_settled_without_a_search(frame):
    from kinsieve.session import _WRITTEN

    rows = [("g", 1, "s", "x", None, 5), ("g", 1, "s", None, "y", 9), ("g", 2, "t", "z", "z", 1), ("h", 3, "t", "z", "z", 1)]
    written = len(_WRITTEN)
    got = truth.truth_discovery(frame("fp string, id long, src string, a string, b string, n int", *rows), F.col("fp"), F.col("id"), F.col("src"), {"a": F.col("a"), "b": F.col("b")}, [F.col("n")])
    # copies of a row id with unlike fields each count, as in the SQL
    assert {(r.grp, r.field_name, r.value, r.row_id) for r in got.collect()} == {("g", "a", "x", 1), ("g", "b", "y", 1)} and len(_WRITTEN) == written


def test_truth_learns_reliable_sources(frame):
    # source g agrees with the majority elsewhere, source h never: a tie goes to g
    rows = [(f"k{i}", 10 * i + j, s, v) for i in range(20) for j, (s, v) in enumerate([("g", "yes"), ("m", "yes"), ("h", "no")])]
    rows += [("tie", 900, "g", "left"), ("tie", 901, "h", "right")]
    got = truth.truth_discovery(frame("fp string, id long, src string, a string", *rows), F.col("fp"), F.col("id"), F.col("src"), {"a": F.col("a")})
    assert {r.grp: r.value for r in got.collect()}["tie"] == "left"


# addresses


def test_read_address():
    r = places.read_address
    assert r("c/o Roe, 3210  Hazel Run Ter. #9, West Upridge 20101", None) == ("20101", "3210", "9", ["hazel", "run", "ter"], "west upridge")
    assert r("APT. 3C 16 S CLOVER PARKWY\nSaint Newton VT 08101", "") == ("08101", "16", "3c", ["s", "clover", "parkwy"], "saint newton vt")
    assert r("Longwick, MI 409037146 - 8908 HICKORY HILL", None)[:4] == ("40903", "8908", "", ["hickory", "hill"])
    assert r("5, FERN DRIVE, Fort Iverbury, TN 329029804", None)[:4] == ("32902", "5", "", ["fern", "drive"])
    assert r("P O Box 26", "4101") == ("04101", "26", "", ["pobox"], "")
    for nothing in (None, "", " ", "N/A", "ON FILE", "SAME AS ORG", "VACANT LAND"):
        assert r(nothing, "12345") is None


def test_same_places(frame, spark):
    rows = []
    for i in range(60):  # streets whose spellings agree elsewhere
        a, b = [("Street", "St"), ("Avenue", "Av"), ("Lane", "Ln")][i % 3]
        name = ["Maple", "Cedar", "Walnut", "Hickory"][i % 4]
        rows += [(f"a{i}", f"{100 + i} {name} {a}", "Reno", "NV", "89501"), (f"b{i}", f"{100 + i} {name.upper()} {b}.", "RENO", "NV", "89501-1234")]
    rows += [("u1", "500 Maple Street Apt 2", "Reno", "NV", "89501"), ("u2", "500 Maple St Apt 3", "Reno", "NV", "89501"), ("u3", "500 Maple St", "Reno", "NV", "89501")]
    rows += [("t1", "600 Hickory Lane", "Reno", "NV", "89501"), ("t2", "600 Hikcory Ln", "Reno", "NV", "89501"), ("z1", "600 HICKORY LN", "Reno", "NV", None), ("n1", None, None, None, None), ("n2", "N/A", "Reno", "NV", "89501"), ("t1", "600 Hickory Lane", "Reno", "NV", "89501")]
    rows += [("k1", "700 Maple Street", "Reno", "NV", "89501"), ("k2", "700 Maple Avenue", "Reno", "NV", "89501")]
    got = {(r.rec_a, r.rec_b) for r in addresses.place_pairs(addresses.same_places(frame("rec string, line string, city string, state string, zip string", *dict.fromkeys(rows)))).collect()}
    assert got == {(f"a{i}", f"b{i}") for i in range(60)} | {("t1", "t2"), ("t1", "z1"), ("t2", "z1")}
    none = spark.createDataFrame([], "rec string, line string, city string, state string, zip string")
    assert addresses.place_pairs(addresses.same_places(none)).count() == 0


def test_every_pair_of_a_slot_votes(frame):
    # a slot of many spellings, more than a row pairs, where neither word of the rewrite comes late in the alphabet
    others = [f"zz{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(addresses.CHUNK + 10)]
    rows = [("89501", str(k), [w, name]) for k, name in enumerate(("maple", "cedar", "walnut", "hickory")) for w in ["avenue", "avnue", *others]]
    rows += [("89501", str(100 + k), ["avenue", f"elm{k}"]) for k in range(30)] + [("89501", str(200 + k), [w, f"oak{k}"]) for k in range(30) for w in ("street", "lane")]
    got = {r.word: r.meant for r in addresses.mine(frame("zip string, number string, words array<string>", *rows)).collect()}
    assert got["avnue"] == "avenue"


def test_rewrites_go_on_until_none_is_new(frame, monkeypatch):
    steps = iter([(f"w{i}", f"w{i + 1}") for i in range(9)])

    def one_more(forms):
        step = next(steps, None)
        return forms.sparkSession.createDataFrame([step] if step else [], "word string, meant string")

    monkeypatch.setattr(addresses, "mine", one_more)
    rows = [("a", "100 Maple w0", "Reno", "NV", "89501"), ("b", "100 Maple w9", "Reno", "NV", "89501")]
    monkeypatch.setattr(addresses, "read_all", lambda records: records)
    read = frame("rec string, zip string, number string, unit string, words array<string>, city string, state string", *[(r, "89501", "100", "", ["maple", line.split()[-1]], "reno", "nv") for r, line, *_ in rows])
    assert [(r.rec_a, r.rec_b) for r in addresses.place_pairs(addresses.same_places(read)).collect()] == [("a", "b")]


# names and people


def test_read_name():
    g = names.GivenNames(["john", "jane", "mary", "cyrus"])
    r = lambda t: names.read_name(t, g)
    assert r("SMITH JR., JOHN A. MD") == ("p", "smith", "john", "a", "jr")
    assert r("John A Smith, Jr") == r("SMITH JOHN A JR.") == ("p", "smith", "john", "a", "jr")
    assert r("Smith-Jones, Jhon") == ("p", "smithjones", "john", "", "") and r("Roe, Petre") == ("p", "roe", "petre~", "", "")
    assert r("Acme Foundation")[0] == r("First National Bank")[0] == r("Sierra Club")[0] == r("Roe & Doe Associaiton")[0] == "o" and r("John Church") == r("Church, John") == ("p", "church", "john", "", "")
    assert r("D. Cyrus Roe - UNTIL JUNE 2024") == ("p", "roe", "d", "cyrus", "")
    assert r("The Roe & Doe Mfg, L.L.C.") == ("o", "roedoe", "manufacturing", "", "")
    for nobody in (None, "", "  ", "N/A", "VACANT", "SEE STATEMENT 4", "-"):
        assert r(nobody) is None


def naive_linkage(n, similar, threshold, missing):
    groups = [[i] for i in range(n)]
    s = lambda a, b: similar.get((min(a, b), max(a, b)), missing)
    while True:
        best = max(((sum(s(a, b) for a in x for b in y) / len(x) / len(y), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j), default=(-9e9, 0, 0))
        if best[0] <= threshold:
            return {frozenset(g) for g in groups}
        i, j = -best[1], -best[2]
        groups[i] = groups[i] + groups.pop(j)


def test_average_linkage_against_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randint(1, 9)
        similar = {(i, j): rng.uniform(-5, 6) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.8}
        out = defaultdict(set)
        for i, c in enumerate(persons.average_linkage(n, similar)):
            out[c].add(i)
        assert {frozenset(g) for g in out.values()} == naive_linkage(n, similar, 0.0, -6.0)


def test_average_linkage_of_many():
    rng = random.Random(6)
    for n in (70, 90):
        similar = {(i, j): rng.uniform(-4, 7 if i % 7 == j % 7 else -1) for i in range(n) for j in range(i + 1, n)}
        groups = lambda labels: {frozenset(i for i, c in enumerate(labels) if c == k) for k in labels}
        assert groups(persons.average_linkage(n, similar)) == groups(persons.average_linkage(n, similar, large=1000))


VECTORS = persons.Vectors({}, 1000)


def test_whole_names_against_brute_force():
    rng = random.Random(9)
    names_ = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(80)})
    own = [VECTORS.of(n) for n in names_]
    want = {(i, j) for i in range(len(names_)) for j in range(i + 1, len(names_)) if sum(x * own[j].get(g, 0) for g, x in own[i].items()) >= 0.5}
    assert set(persons.similar_names(names_, VECTORS, 0.5)) == want and want


@pytest.mark.parametrize("person", [True, False])
def test_alike_names_lose_no_evidence(person, monkeypatch):
    rng = random.Random(5)
    sure = lambda: "".join(rng.choice(["ro", "ber", "tson", "man", "ey", "li", "de", "x"]) for _ in range(rng.randint(1, 4)))
    groups = [[f"{g} {s}$" for s in dict.fromkeys(sure() for _ in range(n))] for g, n in (("^jane", 60), ("^christopher", 40), ("^bo", 1), ("", 30))]
    names_ = [x for g in groups for x in g]
    surname = lambda i: names_[i].split(" ")[1][:-1]
    told = lambda i, j, c: persons.surname_penalty(surname(i), surname(j), c if person else 0.0) is not None
    want, start = {}, 0
    for g in groups:
        want |= {(start + i, start + j): c for (i, j), c in persons.similar_names(g, VECTORS).items() if told(start + i, start + j, c)}
        start += len(g)
    for batch in (2, 50, 1000):
        monkeypatch.setattr(persons, "BATCH", batch)
        got = {(i, j): c for i, j, c in persons.alike_names(groups, VECTORS, person=person)}
        assert {k: c for k, c in got.items() if told(*k, c)} == want and want


@pytest.mark.parametrize("kind", ["p", "o"])
def test_names_of_a_block_meet_once(kind, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ro", "ber", "tson", "man", "ey", "li"]) for _ in range(rng.randint(1, 4)))
    nodes = [persons.Evidence(kind, word(), rng.choice(["christopher", "jane", "j", "", "chris"]), "", "", "89501", "", "", "", "") for _ in range(120)]
    asked, join = [], persons.alike_names
    monkeypatch.setattr(persons, "alike_names", lambda groups, *a: asked.append(sum(map(len, groups))) or join(groups, *a))
    alike = persons.Alike(nodes, VECTORS)
    for own in (nodes[:40], nodes[40:]):
        want = {(i, j): s for i, j, s in persons.evidence_pairs(own, VECTORS) if s > persons.MISSING}
        asked.clear()
        got = {(i, j): s for i, j, s in persons.evidence_pairs(own, VECTORS, alike=alike)}
        assert {k: s for k, s in got.items() if s > persons.MISSING} == pytest.approx(want) and want and not asked
        assert persons.cluster_block(own, VECTORS, alike=alike) == persons.cluster_block(own, VECTORS)
    # every pair that the names do not exclude is there
    names_ = [(e.name, e.short) for e in nodes]
    for i, a in enumerate(nodes):
        for j in range(i):
            b = nodes[j]
            p, q, met = (a.name, b.name, alike.whole) if a.sure and b.sure else (a.short, b.short, alike.short)
            c = persons._cosine(p, q, VECTORS)
            if p != q and (not (a.sure and b.sure) or a.bases == b.bases) and c >= persons.LEAST + 1e-9 and persons.unlike(a, b, c) is not None:
                assert any({x, y} == {p, q} for x, y, _ in met), (p, q, names_)


def test_names_joined_in_parts(monkeypatch):
    rng = random.Random(3)
    names_ = sorted({" " + "".join(rng.choice("abcé") for _ in range(rng.randint(0, 9))) + "$" for _ in range(90)})
    own = [VECTORS.of(n) for n in names_]
    for posted in (None, 0, 7, len(names_)):
        most = len(names_) if posted is None else posted
        want = {(i, j): sum(x * own[j].get(g, 0) for g, x in own[i].items()) for i in range(most) for j in range(i + 1, len(names_))}
        for cells in (1, 1000, 1 << 20):
            monkeypatch.setattr(persons, "CELLS", cells)
            assert persons.similar_names(names_, VECTORS, 0.47, posted) == pytest.approx({k: c for k, c in want.items() if c >= 0.47})


def test_edits_are_counted_only_where_letters_allow(monkeypatch):
    asked = []
    monkeypatch.setattr(persons, "edits", lambda p, q: asked.append((p, q)) or 9)
    surnames = [a + b + "son" for a in ("pqu", "wib", "zyg") for b in ("ehtm", "kaol", "rudf")]
    nodes = [persons.Evidence("p", s, "christopher", "", "", "89501", "", "", "", "") for s in surnames]
    assert len(set(persons.cluster_block(nodes, VECTORS)[0])) == len(nodes)
    # of 36 pairs
    assert len(asked) < 18


def test_unlike_evidence_is_never_left_out():
    # people named alike at one zip with unlike employers and streets: as many clusters as records, at any number
    rng = random.Random(8)
    for n in (80, 450):
        nodes = [persons.Evidence("p", "roe", "jane", "", "", "89501", "acme" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)), "", f"{i} ", "") for i in range(n)]
        assert len(set(persons.cluster_block(nodes, VECTORS)[0])) == n


def test_initials_go_to_one_cluster_or_stay_alone():
    ev = lambda first, emp, suffix="": persons.Evidence("p", "roe", first, "", suffix, "89501", emp, "", "", "")
    labels, strength = persons.cluster_block([ev("jane", "acme"), ev("john", "zenith"), ev("j", "zenith"), ev("j", "other"), ev("jon~", "zenith")], VECTORS)
    assert labels[2] == labels[1] == labels[4] != labels[0] and labels[3] == 3
    assert strength[0] == strength[1] == float("inf") > strength[2] > 0 == strength[3]


PEOPLE = "rec string, name string, city string, state string, zip string, employers array<string>, occupation string, address string, org string"


def person(rec, name, zip_="89501", emp=None, occ=None, address=None):
    return (rec, name, "Reno", "NV", zip_, [emp] if emp else [], occ, address, None)


def test_person_clusters(frame, spark):
    filler = [person(f"f{i}", f"{s}, {g}") for i, (s, g) in enumerate((s, g) for s in ("HARROWGATE", "BELLINGROVE", "CASTERWICK") for g in ("JOHN", "JANE", "MARY", "CYRUS"))]
    rows = [
        person("1", "PHILERBY, WILLIAM J", emp="Acme Steel", occ="WRITER"), person("2", "Bill Philerby", emp="ACME STEEL INC", occ="WRITER"), person("3", "PHILERBY, W.", emp="Acme Steel"),
        person("4", "PHILEBY, WILLIAM", emp="Acme Steel", occ="writer"), person("5", "PHILERBY, WILLIAM", emp="Zenith Mills", occ="NURSE", zip_="89503"),
        person("6", "PHILERBY SR, ANITA"), person("7", "Anita Philerby Jr"), person("8", "Philerby Holdings LLC"), person("9", "PHILERBY HLDGS"), person("10", None), person("11", "N/A"), person("12", "  "),
        person("13", "PHILERBY, WILLIAM J", zip_=None, emp="Acme Steel", occ="WRITER"), person("14", "x" * 4000), ("15", None, None, None, None, None, None, None, None),
    ]
    d = frame(PEOPLE, *rows, *filler)
    people = persons.read_people(d, ["william", "anita", "john", "jane", "mary", "cyrus"], ["Steel", "Mills"])
    by = defaultdict(set)
    for r in persons.person_clusters(people).collect():
        by[r.cluster].add(r.rec)
    groups = {frozenset(g) for g in by.values() if len(g) > 1}
    assert groups == {frozenset({"1", "2", "3", "4", "13"}), frozenset({"8", "9"})}
    pairs = persons.variant_pairs(persons.person_clusters(people)).collect()
    assert ("1", "13") not in {(r.rec_a, r.rec_b) for r in pairs} and all(r.rec_a < r.rec_b for r in pairs)
    assert persons.person_clusters(persons.read_people(spark.createDataFrame([], PEOPLE), [], [])).count() == 0


def test_the_cosine_join_decides(frame):
    people = persons.read_people(frame(PEOPLE, person("1", "PHILERBY, WILLIAM"), person("2", "PHILEBY, WILLIAM"), person("3", "PHILERBY, WILLIAM", emp="Acme Steel")), ["william"], ["Steel"])
    groups = lambda **kw: len({r.cluster for r in persons.person_clusters(people, **kw).collect()})
    assert groups() == 1 and groups(least=1.1) == 2


def test_hot_blocks_are_split_without_loss(frame, spark):
    rng = random.Random(4)
    rows = []
    for p in range(60):
        sur = "".join(rng.choice(["phil", "man", "tor", "hesk", "vash", "quil"]) for _ in range(3))
        firm = "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(9))
        for k in range(4):
            at = rng.randint(1, len(sur) - 2)
            rows.append(person(f"{p}:{k}", f"{sur[:at] + sur[at + 1:] if k == 3 else sur}, {rng.choice(['WILLIAM', 'BILL', 'W.'])}", emp=f"{firm} Steel", occ=rng.choice(["WRITER", None]), zip_=rng.choice(["89501", None])))
    people = persons.read_people(frame(PEOPLE, *rows), ["william"], ["Steel"])

    def groups(split):
        by = defaultdict(set)
        for r in persons.person_clusters(people, split=split).collect():
            by[r.cluster].add(r.rec)
        return {frozenset(g) for g in by.values()}

    whole, parts = groups(10_000), groups(120)
    pairs = lambda gs: {(a, b) for g in gs for a in g for b in g if a < b}
    lost, won = pairs(whole) - pairs(parts), pairs(parts) - pairs(whole)
    assert len(lost) + len(won) <= 0.05 * len(pairs(whole)), (len(pairs(whole)), len(lost), len(won))


def hot_people(seed):
    """Alike names, initials and short names, people of either side with several records, in one place."""
    rng = random.Random(seed)
    rows = []
    for p in range(70):
        sur, firm = rng.choice(["manhesk", "torvash", "quilman"]) + rng.choice(["", "ton", "man"]), rng.choice(["grisowlin", "zenfarok", "tolbarit", "wexhammer"])
        first, nick = rng.choice([("WILLIAM", "BILL"), ("WALTER", "WALT"), ("WANDA", "WANDA")])
        for k in range(4):
            at = rng.randint(1, len(sur) - 2)
            name = f"{sur[:at] + sur[at + 1:] if rng.random() < 0.2 else sur}, {rng.choice([first, nick, first[0] + '.', first + ' J'])}"
            rows.append(person(f"{rng.choice('lr')}:{p}:{k}", name, emp=rng.choice([f"{firm} Steel", None]), occ=rng.choice(["WRITER", "NURSE", None]), zip_=rng.choice(["89501", "89502"])))
    return rows


def test_clusters_do_not_depend_on_the_split(frame):
    people = persons.read_people(frame(PEOPLE, *hot_people(8)), ["william", "walter", "wanda"], ["Steel"])
    of = lambda split: {(r.rec, r.cluster) for r in persons.person_clusters(people, split=split).collect()}
    whole = of(10_000)
    assert len({c for _, c in whole}) < 0.8 * len(whole) and of(60) == whole and of(15) == whole


def test_links_do_not_depend_on_the_split(frame):
    people = persons.read_people(frame(PEOPLE, *hot_people(9)), ["william", "walter", "wanda"], ["Steel"]).withColumn("side", F.substring("rec", 1, 1))
    of = lambda split: {(r.left_rec, r.right_rec, round(r.probability, 6)) for r in persons.linked_sources(people, split=split).collect()}
    whole = of(10_000)
    assert len(whole) > 20 and of(25) == whole


def test_linked_sources(frame):
    rows = [
        person("l:P1", "William J Philerby", emp="Acme Steel"), person("l:P2", "Anita Philerby Sr"), person("l:P3", "Anita Philerby Jr"), person("l:P4", "Mary Nobody"),
        person("r:1", "PHILERBY, BILL", emp="ACME STEEL"), person("r:2", "PHILERBY, ANITA SR"), person("r:3", "PHILERBY, ANITA JR."), person("r:4", "PHILERBY, WILLIAM", emp="Zenith Mills", occ="NURSE", zip_="89503"), person("r:5", None),
    ]
    people = persons.read_people(frame(PEOPLE, *rows), ["william", "anita", "mary"], ["Steel", "Mills"]).withColumn("side", F.substring("rec", 1, 1))
    got = {(r.left_rec, r.right_rec): r.probability for r in persons.linked_sources(people).where("probability >= 0.5").collect()}
    assert set(got) == {("l:P1", "r:1"), ("l:P2", "r:2"), ("l:P3", "r:3")} and all(0.5 <= p <= 1 for p in got.values())


def brute_marginals(pairs):
    import itertools
    import math

    edges = list(pairs.items())
    total, mass = 0.0, defaultdict(float)
    for on in itertools.product((0, 1), repeat=len(edges)):
        chosen = [e for e, x in zip(edges, on) if x]
        ls, rs = [e[0][0] for e in chosen], [e[0][1] for e in chosen]
        if len(set(ls)) == len(ls) and len(set(rs)) == len(rs):
            w = math.exp(sum(s for _, s in chosen))
            total += w
            for e in chosen:
                mass[e[0]] += w
    return {e: mass[e] / total for e, _ in edges}


def test_belief_propagation_is_exact_on_trees(frame, spark):
    pairs = {("a", "x"): 2.0, ("a", "y"): 1.0, ("b", "y"): 0.5, ("c", "z"): 3.0, ("d", "w"): -1.0}
    d = frame("l string, r string, s double", *[(*k, v) for k, v in pairs.items()], ("a", "x", 1.0), (None, "x", 9.0))
    got = {(r.l, r.r): r.probability for r in belief.match_probabilities(d, "l", "r", "s", tolerance=1e-6, max_rounds=60).collect()}
    want = brute_marginals(pairs)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    assert belief.match_probabilities(spark.createDataFrame([], "l string, r string, s double"), "l", "r", "s").count() == 0


# people in two places

MOVED = [
    person("l:1", "Cyrus N Farethovic", zip_="29302", emp="Grisowlin Steel"), person("r:2", "FARETHOVIC, CYRUS N", zip_="44902", emp="GRISOWLIN STEEL INC"), person("r:3", "FARETHOVIC, CYRUS N", zip_="29302", emp="Grisowlin Steel"),
    person("r:4", "FARETHOVIC, ANITA", zip_="44902", emp="Grisowlin Steel"), person("r:5", "FARETHOVIC, CYRUS N", zip_="60601", emp="Zenith Mills"), person("r:6", "FARETHOVIC JR, CYRUS N", zip_="70112", emp="Grisowlin Steel"), person("r:7", "FARETHOVIC SR, CYRUS N", zip_="80202", emp="Grisowlin Steel"),
]


def test_one_employer_in_two_places(frame):
    people = persons.read_people(frame(PEOPLE, *MOVED[:5]), ["cyrus", "anita"], ["Steel", "Mills"])
    by = defaultdict(set)
    for r in persons.person_clusters(people).collect():
        by[r.cluster].add(r.rec)
    assert {frozenset(g) for g in by.values()} == {frozenset({"l:1", "r:2", "r:3"}), frozenset({"r:4"}), frozenset({"r:5"})}


def test_contradictions_stay_apart_across_places(frame):
    people = persons.read_people(frame(PEOPLE, *MOVED[5:]), ["cyrus", "anita"], ["Steel", "Mills"])
    assert len({r.cluster for r in persons.person_clusters(people).collect()}) == 2


def test_sources_linked_across_places(frame):
    people = persons.read_people(frame(PEOPLE, *MOVED[:5]), ["cyrus", "anita"], ["Steel", "Mills"]).withColumn("side", F.substring("rec", 1, 1))
    assert {(r.left_rec, r.right_rec) for r in persons.linked_sources(people).where("probability >= 0.5").collect()} == {("l:1", "r:2"), ("l:1", "r:3")}


def test_only_nodes_of_several_blocks_are_settled(frame, monkeypatch):
    written, write = {}, persons.materialize
    monkeypatch.setattr(persons, "materialize", lambda df, label: written.setdefault(label, write(df, label)))
    inf = float("inf")
    rows = [(1, 10, inf, False), (2, 10, inf, True), (2, 20, inf, True), (3, 20, 1.0, True), (3, 30, 2.0, True), (4, 40, 0.0, True)]
    clusters, links = persons.settle(frame("node long, cluster long, strength double, shared boolean", *rows))
    assert {(r.node, r.cluster) for r in clusters.collect()} == {(1, 10), (2, 20), (3, 30), (4, 40)}
    assert [(r.a, r.b) for r in links.collect()] == [(10, 20)]
    assert {r.node for r in written["memberships"].collect()} == {2, 3, 4}


def test_components(frame):
    rows = [(i, i + 1) for i in range(9)] + [(20, 21), (30, 21)]
    assert {(r.a, r.root) for r in persons.components(frame("a long, b long", *rows)).collect()} == {(i, 0) for i in range(10)} | {(i, 20) for i in (20, 21, 30)}
