import random

from pyspark.sql import functions as F

from chirpmill.llm import lines
from chirpmill.llm.queries import QUERIES
from sql import write


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n, letters="abcdé "):
    text = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice(letters)
        elif kind == 1:
            text.insert(at, rng.choice(letters))
        else:
            del text[at]
    return "".join(text)


def test_band_equals_plain_distance(spark):
    rng = random.Random(1)
    for edits in (1, 2, 3):
        pairs = []
        for _ in range(400):
            a = "".join(rng.choice("abcé") for _ in range(rng.randint(4, 40)))
            pairs.append((a, edited(rng, a, rng.randint(0, edits + 2), "abcé")))
        pairs = [(a, b) for a, b in pairs if len(b) > edits]
        got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within("a", "b", edits).alias("near")).collect()
        for r in got:
            assert r["near"] == (distance(r["a"], r["b"]) <= edits), (r, edits)


def brute(rows, edits=lines.EDITS):
    """Places that go, by the rule alone."""
    at = {}
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.strip()
            if len(line) >= lines.MIN_CHARS:
                at.setdefault((doc, no), line)
    first = {}
    for place in sorted(at, key=lambda p: (p[0] is not None, p[0] or 0, p[1])):
        first.setdefault(at[place], place)
    order = {p: k for k, p in enumerate(sorted(at, key=lambda p: (p[0] is not None, p[0] or 0, p[1])))}
    same = {p for p in at if first[at[p]] != p}
    near = {p for t, p in first.items() for u, q in first.items()
            if order[q] < order[p] and abs(len(t) - len(u)) <= edits and distance(t, u) <= edits}
    return same, near


def test_drops_what_the_rule_drops(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    base = [" ".join(word() for _ in range(rng.randint(5, 9))) for _ in range(12)]
    base = [b for b in base if len(b) >= 24]
    # lines that share a long part, so that groups of candidates are larger than what is near
    base += [base[0][:20] + "".join(rng.choice("abcd") for _ in range(20)) for _ in range(6)]
    rows = []
    for doc in range(60):
        text = [rng.choice(["short", "", "  ", word()]) if rng.random() < .3 else edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(0, 6))]
        rows.append((doc, "\n".join(text)))
    rows += [(70, None), (71, ""), (None, base[0]), (72, base[0] + "\n" + base[0] + " \n x"), (72, base[0] + "\n" + base[0] + " \n x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("no", F.lit(1)).withColumn("line", F.lit("z")).withColumn("gone_nos", F.lit("q"))
    same, near = brute(rows)
    got = {(r["doc_id"], r["no"]): r["near"] for r in lines.dropped(docs).collect()}
    assert {p for p, n in got.items() if not n} == same
    assert {p for p, n in got.items() if n} == near
    assert len(near) > 20
    kept, lost = lines.dedup(docs)
    assert kept.columns == docs.columns
    out = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    gone = same | near
    want = sorted(((d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in rows), key=str)
    assert out == want
    assert {(r["doc_id"]): (r["n_same"], r["n_near"]) for r in lost.collect()}[72] == (
        sum(1 for p in same if p[0] == 72), sum(1 for p in near if p[0] == 72))


def test_nothing(spark):
    kept, lost = lines.dedup(spark.createDataFrame([], "doc_id long, text string"))
    assert kept.collect() == [] and lost.collect() == []


def test_query_drops_short_repeats_but_compares_only_long_lines_by_edits(spark, tmp_path):
    rng = random.Random(4)
    short = ["Les.", "And ornd.", "x", "Les", "a line of 19 chars.", "é", " \t", ""]
    long = ["this line has twenty-five", "this line has twenty five", "quite another line, and long"]
    rows = [(i, "\n".join(rng.choice(["", " "]) + rng.choice(short + long) + rng.choice(["", " \r"]) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    rows += [(50, None), (51, "Les."), (None, "Les.\nonly null")]
    seen, first, want = set(), [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept, same, near = [], 0, 0
        for raw in (text or "").split("\n"):
            line = raw.strip()
            if line in seen:
                same += 1
            elif len(line) >= lines.MIN_CHARS and any(distance(line, other) <= lines.EDITS for other in first):
                near += 1
            else:
                kept.append(raw)
            if line and line not in seen:
                seen.add(line)
                first += [line] if len(line) >= lines.MIN_CHARS else []
        want[doc] = (None if text is None else len("\n".join(kept)), same, near)
    folder = write(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_chars_kept"], r["n_same"], r["n_near"]) for r in QUERIES["op5_line_dedup"](spark, folder).collect()}
    assert {d: v for d, v in got.items() if v != want[d]} == {} and len(got) == len(rows)
    assert got[51] == (0, 1, 0) and sum(n for _, _, n in got.values()) > 0


def test_large_groups_and_shared_hashes_drop_what_the_rule_drops(spark, monkeypatch):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)) + "z" for n in (24, 31, 60)]
    rows = [(i, "\n".join("q" + edited(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(rng.randint(1, 3)))) for i in range(90)]
    rows += [(None, "q" + base[0]), (-2**63, "q" + base[1]), (2**63 - 1, "q" + base[2] + "\nq" + base[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(want[1]) > 40
    monkeypatch.setattr(lines, "FEW", 1)
    for shared in (False, True):
        if shared:  # every hash that three rows share is dealt
            monkeypatch.setattr(lines, "LOOKED_AT", 1)
            monkeypatch.setattr(lines, "HOT", 10**9)
        got = {(r["doc_id"], r["no"]): r["near"] for r in lines.dropped(docs).collect()}
        assert {p for p, n in got.items() if not n} == want[0]
        assert {p for p, n in got.items() if n} == want[1]


def test_ids_that_are_no_numbers(spark):
    rows = [("b", "a line that stands twice, nearly"), ("a", "a line that stands twice, neatly"), (None, "another that stands here alone"),
            ("c", "a line that stands twice, neatly")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, lines.dropped(docs).collect())) == [("b", 0, True), ("c", 0, False)]


def test_near_lines_share_a_fine_hash(spark):
    rng = random.Random(7)
    for edits in (1, 2, 3):
        rows = []
        for k in range(120):
            a = "".join(rng.choice("abc") for _ in range(rng.randint(20, 45)))
            rows += [(k, 0, a), (k, 1, edited(rng, a, edits, "abc"))]
        table = spark.createDataFrame(rows, "k int, side int, line string").withColumn("size", F.length("line"))
        met = {r["k"] for r in lines.fine_keys(table, edits).groupBy("k", "key").agg(F.countDistinct("side").alias("n")).where("n = 2").collect()}
        assert met == set(range(120)), edits


def test_an_edit_changes_four_parities_of_neighbours_at_most(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abcdé") for _ in range(rng.randint(3, 60)))
        edits = rng.randint(0, 3)
        rows.append((a, edited(rng, a, min(edits, len(a) - 2)), edits))
    differ = F.bit_count(lines.neighbour_parity(F.col("a")).bitwiseXOR(lines.neighbour_parity(F.col("b"))))
    got = spark.createDataFrame(rows, "a string, b string, edits int").select("edits", differ.alias("n")).collect()
    assert all(r["n"] <= 4 * r["edits"] for r in got) and any(r["n"] for r in got)


def test_what_the_filters_need_is_fetched_once(spark, monkeypatch):
    """Members of a group hold sizes and parities; they were joined with them for each side of each comparison."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(120))
    places = [rng.randrange(100) for _ in range(150)]
    rows = [(i, base[:p] + "".join(rng.choice("ijklmnopqrst") for _ in range(5)) + base[p:]) for i, p in enumerate(places)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = lines.earlier

    def looked_at(members, edits):
        seen.append(members._jdf.queryExecution().optimizedPlan().toString())
        return real(members, edits)

    monkeypatch.setattr(lines, "earlier", looked_at)
    same, near = brute(rows)
    got = {(r["doc_id"], r["no"]): r["near"] for r in lines.dropped(docs).collect()}
    assert {p for p, n in got.items() if n} == near and {p for p, n in got.items() if not n} == same
    assert len(seen) == 2 and not any("Join" in plan for plan in seen)
