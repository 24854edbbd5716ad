from sql import same_as_sql, write

from chirpmill.llm import quotations
from chirpmill.llm.queries import QUERIES

TALK = [
    (1, 0, "user", "How do I sort a list?\nIt is long."),
    (1, 1, "assistant", "Use sorted().\n\nIt returns a new list."),
    (1, 2, "user", "Ann wrote:\n> How do I sort a list?\n> It is long.\nMe too."),
    (1, 3, "assistant", "> use   SORTED().\nYes.\n>> It is long.\nagain"),
    (1, 4, "user", "Bob wrote:\n> > It is long.\n> Me too.\n\nThanks"),
    (1, 5, "user", "> never said\nHm"),
    (1, 6, "user", "> Thanks\nand > not a quote\r\n> later"),
    (1, 7, "user", "later"),
    (2, 0, "user", "> Thanks\nother talk"),
    (2, 1, "user", ""),
    (2, 2, "user", ">\n> \n>"),
    (2, 3, "user", "  \n x \n"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_links_order_and_own_words(spark, tmp_path):
    folder = write(spark, tmp_path, conversations=(TALK, SCHEMA))
    assert same_as_sql(spark, folder, "op7_quotations", "conversations") == "ok"
    rows = {(r["conv_id"], r["turn"]): r for r in QUERIES["op7_quotations"](spark, folder).collect()}
    parent = {k[1]: r["parent_turn"] for k, r in rows.items() if k[0] == 1}
    assert parent == {0: None, 1: None, 2: 0, 3: 1, 4: 2, 5: None, 6: 4, 7: None}
    assert rows[1, 2]["text"] == "Me too." and rows[1, 3]["text"] == "Yes.\nagain" and rows[1, 4]["text"] == "Thanks"
    assert rows[1, 6]["root_turn"] == 0 and rows[1, 6]["depth"] == 3
    order = sorted((r["position"], k[1]) for k, r in rows.items() if k[0] == 1)
    assert [t for _, t in order] == [0, 2, 4, 6, 1, 3, 5, 7]
    assert rows[2, 0]["parent_turn"] is None and rows[2, 0]["n_quotes"] == 1 and rows[2, 2]["n_quotes"] == 0


def test_odd_rows(spark):
    rows = [(None, 1, "u", "a"), (None, 2, "u", "> a"), (3, None, "u", "> a"), (3, 1, None, None), (3, 1, None, None),
            (3, 2, "u", "> " + "x " * 40000 + "\nend"), (3, 1, "u", "x " * 40000)]
    got = quotations.conversations(
        spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "'a' as position", "2 as root_turn")).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[None, 2]["parent_turn"] is None and by[3, None]["parent_turn"] is None
    assert by[3, 2]["parent_turn"] == 1 and by[3, 2]["text"] == "end"
    for conv in (None, 3):
        assert sorted(r["position"] for r in got if r["conv_id"] == conv) == list(range(sum(1 for x in rows if x[0] == conv)))
    assert quotations.conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def agrees(spark, tmp_path, *talks):
    rows = [(c, k, "u", t) for c, talk in enumerate(talks) for k, t in enumerate(talk)]
    folder = write(spark, tmp_path, conversations=(rows, SCHEMA))
    return same_as_sql(spark, folder, "op7_quotations", "conversations") == "ok"


def found(spark, talk):
    rows = quotations.conversations(spark.createDataFrame([(1, k, "u", t) for k, t in enumerate(talk)], SCHEMA)).collect()
    return {r["turn"]: (r["parent_turn"], r["depth"], r["n_quotes"], r["n_linked"], r["text"]) for r in rows}


def test_announcing_lines_inside_quotes(spark, tmp_path):
    talk = [
        "text of Ann",
        "reply\n\nOn Mon Ann wrote:\n> text of Ann",
        "more\nOn Tue Bob wrote:\n> reply\n>\n> On Mon Ann wrote:\n>> text of Ann",
        "last\nCy wrote:\n> more\n> On Tue Bob wrote:\n>> reply\n>>\n>> On Mon Ann wrote:\n>>\n>>> text of Ann",
        "> On Tue Bob wrote:\n>> reply\nyes",
        # announced without a deeper quote: these are words
        "Dan said:",
        "> Dan said:\n\nhe did",
    ]
    assert agrees(spark, tmp_path, talk)
    assert found(spark, talk) == {
        0: (None, 0, 0, 0, "text of Ann"), 1: (0, 1, 1, 1, "reply"), 2: (1, 2, 2, 2, "more"), 3: (2, 3, 3, 3, "last"),
        4: (1, 2, 1, 1, "yes"), 5: (None, 0, 0, 0, "Dan said:"), 6: (5, 1, 1, 1, "he did")}


def test_quotes_of_some_lines_or_paragraphs(spark, tmp_path):
    talk = [
        "one a\none b\none c\none d\n\npara two\ngoes on\n\npara three",
        "> one b\n> One   C\nyes",
        "> para two\n> goes on\n>\n> para three\nand",
        # not in this order, and with a line between: nobody said that
        "> one c\n> one b\nno",
        "> one a\n> one c\nneither",
        "one b\none c\nlater too",
        # the first who said it, and the earlier of both ways of saying it
        "> one b\n> one c\nagain",
        # wrapped anew: whole paragraphs only
        "> para two goes\n> on\nwrapped",
    ]
    assert agrees(spark, tmp_path, talk, talk[::-1])
    assert found(spark, talk) == {
        0: (None, 0, 0, 0, talk[0]), 1: (0, 1, 1, 1, "yes"), 2: (0, 1, 1, 1, "and"), 3: (None, 0, 1, 0, "no"),
        4: (None, 0, 1, 0, "neither"), 5: (None, 0, 0, 0, talk[5]), 6: (0, 1, 1, 1, "again"), 7: (0, 1, 1, 1, "wrapped")}


def quoting(lines, a, n):
    return "\n".join("> " + x for x in lines[a:a + n]) + "\nyes"


def test_runs_of_every_number_of_lines(spark, tmp_path):
    lines = [f"line {i % 7} {i % 5}" for i in range(40)]
    same = ["again"] * 20
    talks = [
        ["\n".join(lines)] + [quoting(lines, n % 9, n) for n in range(1, 32)],
        # every line the same: quotes of more lines than were said link to nothing
        ["\n\n".join(same)] + [quoting(same * 2, 0, n) for n in (2, 3, 5, 8, 19, 20, 21, 33)],
        # the first who said it, with both ends right and the middle wrong before
        ["a\nb\nx\nc\nd", "a\nb\nm\nc\nd", "> a\n> b\n> m\n> c\n> d", "> b\n> m\n> c", "> a\n> b\n> c\n> d", "> x\n> c\n> d"],
    ]
    assert agrees(spark, tmp_path, *talks)
    got = found(spark, talks[0])
    assert all(got[n][0] == 0 for n in range(1, 32))
    got = found(spark, talks[1])
    assert [got[i + 1][0] for i in range(8)] == [0] * 6 + [None] * 2
    got = found(spark, talks[2])
    assert [got[i][0] for i in (2, 3, 4, 5)] == [1, 1, None, 0]


def test_long_message_and_quotes_of_many_lengths(spark):
    lines = [f"word {i}" for i in range(3000)]
    got = found(spark, ["\n".join(lines)] + [quoting(lines, 3 * n, 2 + n) for n in range(299)])
    assert all(got[n][0] == 0 for n in range(1, 300))
