import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import Rules
from tessera.operators import access, changes, index, nodes, position, records
from tessera.operators.position import SortKey
from tessera.sources import readers
from tessera.streaming import changes as log

# ------------------------------------------------------------------ nodes

CHART = """<chairman empID="1"><name>Ann</name><president empID="2"><name>Bo</name><division>Toys</division>
<groupvp empID="3"><name>Cy</name><director empID="4"><name>Di</name><region>East</region></director><director empID="5"><name>Ed</name><region>West</region></director></groupvp>
<groupvp empID="6"><name>Flo</name></groupvp></president><president empID="7"><name>Gus</name></president></chairman>"""


@pytest.fixture(scope="module")
def chart(spark):
    docs = spark.createDataFrame([(1, CHART), (2, "<chairman empID='9'><name>Zed</name></chairman>"), (3, "<broken>"), (4, None)], "id bigint, xml string")
    return nodes.import_documents(docs, "id", "xml").cache()


def ids(found):
    return sorted(r.value for r in found.filter("doc_id = 1").join(found.sparkSession.table("chart").filter("name = 'empID'").select("doc_id", F.col("parent").alias("pre"), F.col("value").alias("v")), ["doc_id", "pre"]).select(F.col("v").alias("value")).collect())


def by_id(chart, number):
    owner = chart.filter((F.col("name") == "empID") & (F.col("value") == number)).select("doc_id", F.col("parent").alias("pre"))
    return chart.join(owner, ["doc_id", "pre"], "left_semi").select(*chart.columns)


@pytest.mark.parametrize(
    ("start", "axis", "name", "want"),
    [
        ("1", "child", "president", "27"), ("1", "descendant", "director", "45"), ("1", "descendant", None, "234567"), ("4", "ancestor", None, "123"), ("4", "ancestor-or-self", "director", "4"), ("4", "parent", None, "3"),
        ("4", "following-sibling", None, "5"), ("5", "preceding-sibling", "director", "4"), ("3", "following", None, "67"), ("6", "preceding", None, "345"), ("7", "preceding", "groupvp", "36"), ("4", "root", None, "1"), ("2", "self", None, "2"), ("2", "descendant-or-self", "groupvp", "36"),
    ],
)
def test_axes(spark, chart, start, axis, name, want):
    chart.createOrReplaceTempView("chart")
    assert "".join(ids(nodes.step(by_id(chart, start), chart, axis, name))) == want


def test_occurrences_count_from_each_context(spark, chart):
    chart.createOrReplaceTempView("chart")
    every = nodes.step(chart.filter("name = 'president'"), chart, "child", "groupvp", occurrence=2)
    assert ids(every) == ["6"]
    assert ids(nodes.step(by_id(chart, "4"), chart, "ancestor", occurrence=1)) == ["3"]
    first_names = nodes.step(chart.filter("kind = 'element'"), chart, "child", "name", occurrence=1)
    assert sorted(r.text for r in nodes.string_value(chart, first_names).collect()) == ["Ann", "Bo", "Cy", "Di", "Ed", "Flo", "Gus", "Zed"]


def test_conditions_and_attributes(spark, chart):
    chart.createOrReplaceTempView("chart")
    west = chart.filter("value = 'West'")
    region = nodes.step(west, chart, "parent", "region")
    assert ids(nodes.where(chart.filter("name = 'director'"), region)) == ["5"]
    assert ids(nodes.where(chart.filter("name = 'groupvp'"), region, "descendant")) == ["3"]
    assert [r.value for r in nodes.step(by_id(chart, "6"), chart, "attribute").collect()] == ["6"]
    assert nodes.step(chart.filter("doc_id = 2"), chart, "descendant", "director").count() == 0


@pytest.mark.parametrize("axis", nodes.AXES)
def test_steps_and_conditions_in_blocks(spark, chart, monkeypatch, axis):
    """Each axis, as a step and as a condition, against all pairs of nodes, with documents of many blocks."""
    monkeypatch.setattr(nodes, "BLOCK", 4)
    rows = chart.collect()
    start = [r for r in rows if r.name in ("president", "director", "empID") or r.value == "West"]
    context = spark.createDataFrame(start, chart.schema)
    plain = lambda n: n.kind != "attribute"
    on = {
        "self": lambda c, n: n.pre == c.pre, "child": lambda c, n: n.parent == c.pre and plain(n), "parent": lambda c, n: n.pre == c.parent, "descendant": lambda c, n: c.pre < n.pre <= c.last and plain(n),
        "descendant-or-self": lambda c, n: n.pre == c.pre or c.pre < n.pre <= c.last and plain(n), "ancestor": lambda c, n: n.pre < c.pre <= n.last and n.kind == "element",
        "ancestor-or-self": lambda c, n: n.pre == c.pre or n.pre < c.pre <= n.last and n.kind == "element", "following-sibling": lambda c, n: n.parent == c.parent and c.sibling is not None and n.sibling is not None and n.sibling > c.sibling,
        "preceding-sibling": lambda c, n: n.parent == c.parent and c.sibling is not None and n.sibling is not None and n.sibling < c.sibling, "following": lambda c, n: n.pre > c.last and plain(n), "preceding": lambda c, n: n.last < c.pre and plain(n),
        "attribute": lambda c, n: n.parent == c.pre and n.kind == "attribute", "namespace": lambda c, n: False, "root": lambda c, n: n.depth == 0,
    }[axis]
    met = [(c, n) for c in start for n in rows if c.doc_id == n.doc_id and on(c, n)]
    assert sorted((r.doc_id, r.pre) for r in nodes.step(context, chart, axis).collect()) == sorted({(n.doc_id, n.pre) for _, n in met})
    assert sorted((r.doc_id, r.pre) for r in nodes.where(context, chart, axis).collect()) == sorted({(c.doc_id, c.pre) for c, _ in met})


def test_new_nodes(spark, chart):
    chart.createOrReplaceTempView("chart")
    new = nodes.insert_before(chart, chart.filter("name = 'director'"), "seat", None)
    new = nodes.create_attribute(new, new.filter("name = 'seat' or name = 'groupvp'"), "empID", F.concat(F.lit("n"), F.col("pre")))
    new = nodes.create_annotation(new, new.filter("name = 'seat'"), "unseen")
    own = sorted((r for r in new.collect() if r.doc_id == 1), key=lambda r: r.pre)
    assert [r.pre for r in own] == list(range(len(own))) and [r.value for r in own if r.kind == "annotation"] == ["unseen"] * 2
    for r in own:  # ranges hold all below, links hold
        below, seek = set(), [r.pre]
        while seek:
            below |= set(seek)
            seek = [x.pre for x in own if x.parent in seek]
        assert r.last == max(below) and len(below) == r.last - r.pre + 1
    text = next(r.xml for r in nodes.export_documents(new).collect() if r.doc_id == 1)
    assert text.count("<seat empID=") == 2 and text.count('empID="3"') == 0 and "unseen" not in text
    lines = next(r.xml for r in nodes.export_documents(chart, indent=2, declaration=True).collect() if r.doc_id == 2)
    assert lines.split("\n") == ['<?xml version="1.0" encoding="UTF-8"?>', '<chairman empID="9">', "  <name>Zed</name>", "</chairman>"]


def test_namespaces_of_attributes_come_back(spark):
    xml = '<a xmlns:p="urn:p" p:k="1" k="2"><b xmlns="urn:q"/></a>'
    docs = spark.createDataFrame([(1, xml), (2, "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>")], "i bigint, x string")
    table = nodes.import_documents(docs, "i", "x")
    assert [r.value for r in nodes.step(nodes.roots(table), table, "namespace").collect()] == ["urn:p"]
    assert [r.i for r in nodes.rejected(docs, table, "i").collect()] == [2]
    back = nodes.import_documents(nodes.export_documents(table), "doc_id", "xml")
    named = lambda t: sorted((r.kind, r.name, r.ns or "", r.value or "") for r in t.filter("coalesce(ns, '') <> 'xmlns'").collect())
    assert named(back) == named(table)


def test_meta_links(chart):
    rows = {(r.doc_id, r.pre): r for r in chart.collect()}
    for r in rows.values():
        if r.kind == "attribute":
            continue
        children = sorted(k for (d, k), x in rows.items() if d == r.doc_id and x.parent == r.pre and x.kind != "attribute")
        assert (r.first_child, r.last_child) == ((children[0], children[-1]) if children else (None, None))
        if r.next_sibling is not None:
            assert rows[r.doc_id, r.next_sibling].prev_sibling == r.pre


def test_delete_set_and_export(spark, chart):
    chart.createOrReplaceTempView("chart")
    left = nodes.delete_subtrees(chart, chart.filter("name = 'groupvp'"))
    assert ids(nodes.step(nodes.roots(left), left, "descendant", "president")) == ["2", "7"] and left.filter("name = 'director'").count() == 0
    renamed = nodes.set_value(left, left.filter("value = 'Toys'"), F.lit("Games & more"))
    out = {r.doc_id: r.xml for r in nodes.export_documents(renamed).collect()}
    assert out[1].replace("\n", "") == '<chairman empID="1"><name>Ann</name><president empID="2"><name>Bo</name><division>Games &amp; more</division></president><president empID="7"><name>Gus</name></president></chairman>'
    assert set(out) == {1, 2}


def test_kinds_and_namespaces(spark):
    xml = '<a xmlns="urn:x"><!--c--><?p v?><![CDATA[<b>]]><c/></a>'
    rows = nodes.import_documents(spark.createDataFrame([(1, xml)], "i bigint, x string"), "i", "x").collect()
    assert [(r.kind, r.name, r.ns, r.value) for r in rows] == [("element", "a", "urn:x", None), ("comment", None, None, "c"), ("pi", "p", None, "v"), ("cdata", None, None, "<b>"), ("element", "c", "urn:x", None)]


# ------------------------------------------------------------------ records

TREE = "0 1 context\n1 2 text Mc Duck\n1 3 number 18446744073709551615\n2 4 binary 00ff\n1 6 number 1\n2 4 text deep\n1 6 number 2"


def test_record_trees(spark):
    rows = records.from_text_tree(spark.createDataFrame([(7, TREE), (8, None), (9, "")], "drn bigint, text string"))
    got = {r.drn: r for r in rows.select("drn", records.to_text_tree().alias("t"), records.values_at([3, 4], "binary").alias("b"), records.values_at([6, 4]).alias("d"), records.values_at([4], rooted=True).alias("r"), records.values_of(6, "number").alias("n"), records.has_field(9).alias("h"), records.root_is(1).alias("root")).collect()}
    assert got[7].t == TREE and got[7].b == [bytes([0, 255])] and got[7].d == ["deep"] and got[7].r == [] and [int(x) for x in got[7].n] == [1, 2] and not got[7].h and got[7].root
    assert got[8].t == "" and got[9].n == []
    assert {r.tag: r["count"] for r in records.unknown_tags(rows, spark.createDataFrame([(1,), (2,), (3,), (4,)], "tag int")).collect()} == {6: 2}


def test_text_trees_keep_line_ends(spark):
    values = ["a\nb", "\\n", "x\\\ny", " two  ", "", "\x0b\x1c\u2028|", "\r\n"]
    df = spark.createDataFrame(list(enumerate(values)), "drn bigint, v string").select("drn", F.array(records.make_field(0, None, 0, 1, "context"), records.make_field(1, 0, 1, 2, "text", F.col("v"))).alias("fields"))
    back = records.from_text_tree(df.select("drn", records.to_text_tree().alias("text")))
    assert {r.drn: r.v for r in back.select("drn", records.values_of(2)[0].alias("v")).collect()} == dict(enumerate(values))


# ------------------------------------------------------------------ positions


@pytest.fixture(scope="module")
def names(spark):
    rows = [(1, "b", 2, ["z", "c"]), (2, None, 1, ["a"]), (3, "a", 9, []), (4, "b", 1, None), (5, "C", 5, ["m", None])]
    return spark.createDataFrame(rows, "id bigint, name string, n int, many array<string>")


@pytest.mark.parametrize(
    ("keys", "order"),
    [
        ([SortKey("name")], [2, 5, 3, 1, 4]), ([SortKey("name", missing_high=True)], [5, 3, 1, 4, 2]), ([SortKey("name", descending=True)], [1, 4, 3, 5, 2]), ([SortKey("name", descending=True, missing_high=True)], [2, 1, 4, 3, 5]),
        ([SortKey("name", rules=Rules(no_case=True)), SortKey("n")], [2, 3, 4, 1, 5]), ([SortKey("many", many=True)], [3, 4, 2, 1, 5]), ([SortKey("many", many=True, descending=True)], [1, 5, 2, 3, 4]), ([], [1, 2, 3, 4, 5]),
    ],
)
def test_orders_both_ways(names, keys, order):
    assert [r.id for r in position.ordered(names, keys, "id").collect()] == order
    places = {r.id: r.position for r in position.numbered(names, keys, "id").collect()}
    assert [places[i] for i in order] == [1, 2, 3, 4, 5]
    assert position.first(names, keys, "id").first().id == order[0] and position.last(names, keys, "id").first().id == order[-1]
    assert position.at(names, keys, "id", 2).first().id == order[1] and position.at(names, keys, "id", 0).count() == 0 and position.at(names, keys, "id", -1).count() == 0
    assert position.move(names, keys, "id", order[3], -2).first().id == order[1]
    for a in (0, 2, 4):
        for by in (-1, 0, 2):
            assert [r.id for r in position.move(names, keys, "id", order[a], by).collect()] == ([order[a + by]] if 0 <= a + by < 5 else [])
    assert position.compare_places(names, keys, "id", order[0], order[4]).first().comparison == -1
    assert [r.percent_position for r in position.percent_place(names, keys, "id").orderBy("position").collect()] == [0, 250, 500, 750, 1000]


def test_seek_and_pages(names):
    by_n = [SortKey("n")]
    assert position.seek(names, by_n, "id", 2).first().id == 1 and position.seek(names, by_n, "id", 2, "excluding").first().id == 5 and position.seek(names, [SortKey("n", descending=True)], "id", 4).first().id == 1
    assert [r.id for r in position.next_page(names, by_n, "id", F.col("n") > 1, 2).collect()] == [1, 5]
    assert position.percent_place(names.limit(1), by_n, "id").first().percent_position == 0 and position.at_percent(names, by_n, "id", 900).first().id == 3
    with pytest.raises(ValueError):
        position.seek(names, [], "id", 1)


def test_verify_sort_keys(names):
    position.verify(names, [SortKey("name"), SortKey("many", many=True, limit=2)], "id")
    for keys in ([], [SortKey("name")] * 2, [SortKey("none")], [SortKey("many")], [SortKey("n", many=True)], [SortKey("n", limit=0)]):
        with pytest.raises(ValueError):
            position.verify(names, keys, "id")


def test_retrieve(names):
    got = lambda how, v=None: [r.id for r in access.retrieve(names, "id", v, how).collect()]
    assert got("exact", 3) == [3] and got("including", 3) == [3] and got("excluding", 3) == [4] and got("first") == [1] and got("last") == [5] and got("excluding", 5) == []


# ------------------------------------------------------------------ indexes and changes


def test_keys(spark):
    df = spark.createDataFrame([(1, "O'Neil-Smith  x_1"), (2, None), (3, "")], "id bigint, t string")
    keys = lambda f, **k: sorted((r.drn, r.key) for r in f(df, "id", F.col("t"), **k).collect())
    assert keys(index.word_keys) == sorted((1, w) for w in ("O", "Neil", "Smith", "x", "1"))
    assert keys(index.value_keys, limit=6) == [(1, "O'Neil"), (3, "")]
    subs = keys(index.substring_keys, rules=Rules(no_underscores=True, compress_spaces=True), limit=4)
    assert (1, "x 1") in subs and (1, "h x ") in subs and not any(k.startswith(" ") for _, k in subs)
    assert len(index.sound_keys(df, "id", F.col("t")).collect()) >= 4
    built = index.value_keys(df.filter("id < 2"), "id", F.col("t"))
    assert {r.drn for r in index.extend(built, df, "id", lambda d: index.value_keys(d, "id", F.col("t"))).collect()} == {1, 3}


def test_compound_keys(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "drn bigint, key string"), spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "drn bigint, key string")
    assert index.compound_keys([a, b], [True, True]).count() == 4 and index.compound_keys([a, b], [True, False]).count() == 5 and index.compound_keys([a, b], [False, False]).count() == 6


def test_changes(spark, tmp_path):
    own = spark.createDataFrame([(1, "a", b"x"), (2, "b", None)], "id bigint, t string, b binary")
    assert [(r.t, r.id) for r in changes.update(own, {"t": F.col("id"), "id": F.col("id") + 1}, F.col("t") == "b").collect()] == [("a", 1), ("2", 3)]
    assert changes.delete(own, F.col("b") == b"x").count() == 1 and changes.delete(own).count() == 0
    grown = changes.insert(own, spark.createDataFrame([("7", "z")], "id string, t string"))
    assert [(r.id, r.t, r.b) for r in grown.filter("t = 'z'").collect()] == [(7, "z", None)]
    fresh = changes.reserve_ids(own, spark.range(3).select(F.lit("n").alias("t")), "id").collect()
    assert len({r.id for r in fresh}) == 3 and min(r.id for r in fresh) > 2
    changes.backup(own, f"{tmp_path}/full")
    changes.backup(grown, f"{tmp_path}/later", F.col("id") > 2)
    back = changes.restore(spark.read.parquet(f"{tmp_path}/full"), [spark.read.parquet(f"{tmp_path}/later")], "id")
    assert {r.id for r in back.collect()} == {1, 2, 7}
    assert changes.violations(spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int"), ["k"]).count() == 1


def test_log_replay_in_one_pass_and_as_a_stream(spark, tmp_path):
    rows = [(1, 1, "add", "a"), (2, 2, "add", "b"), (1, 3, "modify", "c"), (2, 4, "delete", None), (3, 5, "add", "d"), (2, 6, "add", "e"), (3, 7, "delete", None)]
    full = spark.createDataFrame(rows, "id int, n int, op string, v string")
    want = {(1, "c"), (2, "e")}
    assert {(r.id, r.v) for r in log.replay(full, ["id"], ["n"], "op").collect()} == want
    start = spark.createDataFrame([(9, 0, "z"), (3, 0, "y")], "id int, n int, v string")
    assert {(r.id, r.v) for r in log.apply(start, full, ["id"], ["n"], "op").collect()} == want | {(9, "z")}
    for i in range(2):
        full.filter(f"n % 2 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    batches = []
    run = log.stream_replay(spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log"), lambda df, number: batches.append((number, df.count())), f"{tmp_path}/ck")
    run.awaitTermination(60)
    assert sum(n for _, n in batches) == 7 and len({b for b, _ in batches}) == 2


def test_windows_and_sessions(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,x,0) as ts, x % 2 as u from values (0),(1),(9),(10),(61) t(x)")
    assert [(r.n) for r in log.windowed(rows, "ts", "10 minutes", [], [F.count("*").alias("n")]).orderBy("window_start").collect()] == [3, 1, 1]
    assert sorted(r.n for r in log.sessions(rows, "ts", "5 minutes", [], [F.count("*").alias("n")]).collect()) == [1, 2, 2]


# ------------------------------------------------------------------ sources


def test_sources(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<all><disc id='1'><title>A</title></disc><disc id='2'><title>B</title></disc></all>")
    assert [r.title for r in readers.xml_rows(spark, f"{tmp_path}/x.xml", "disc").orderBy("_id").collect()] == ["A", "B"]
    texts = readers.whole_texts(spark, f"{tmp_path}/x.xml").withColumn("id", F.lit(1))
    assert nodes.import_documents(texts, "id", "text").filter("name = 'disc'").count() == 2
    assert readers.blobs(spark, f"{tmp_path}/x.xml").count() == 1
    spark.dataSource.register(readers.application_source("own_rows", "n int, half int", 3, lambda part: ((part * 10 + i, part) for i in range(4))))
    assert spark.read.format("own_rows").load().filter("n % 2 = 0").count() == 6
    df = spark.createDataFrame([(b"ab",)], "b binary")
    assert readers.decode_base64(readers.encode_base64(df, "b"), "b").first().b == b"ab"
    readers.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 1
    with pytest.raises(ValueError):
        access.comma_join([df, df], F.lit(True))


def test_text_round_trip_of_all_customers(spark):
    from tessera.plans.queries import person_records

    own = person_records(spark, "/root/testdata/sf0.001")
    back = records.from_text_tree(own.select("drn", records.to_text_tree().alias("text")))
    wanted, found = ({r.drn: r.fields for r in rows.select("drn", "fields").collect()} for rows in (own, back))
    assert found == wanted and len(found) == own.count()


@pytest.mark.parametrize("name", ["record_text_round_trip", "xml_round_trip"])
def test_round_trips_send_no_side_whole_through_the_driver(spark, name):
    from tessera.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_a_change_shuffles_nodes_once(spark, chart, monkeypatch):
    monkeypatch.setattr(nodes, "written", lambda df: df)
    new = nodes.insert_before(chart, chart.filter("name = 'director'"), "seat")
    assert new._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_changes_after_the_last_node_went(spark, chart):
    left = nodes.delete_subtrees(chart, chart.filter("doc_id = 2 and name = 'name'"))
    new = nodes.create_attribute(left, nodes.roots(left), "rank", "1")
    assert [(r.name, r.pre, r.last) for r in new.filter("doc_id = 2").orderBy("pre").collect()] == [("chairman", 0, 2), ("rank", 1, 1), ("empID", 2, 2)]


def test_substring_keys_of_a_record_with_several_rows(spark):
    rows = spark.createDataFrame([(1, "ab b"), (1, "b b"), (1, "ab b"), (2, ""), (3, None), (None, "b")], "i long, t string")
    keys = index.substring_keys(rows, "i", F.col("t"))
    assert "Generate" not in keys._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]  # no keys below the shuffle
    assert sorted((r.drn or 0, r.key) for r in keys.collect()) == [(0, "b"), (1, "ab b"), (1, "b"), (1, "b b")]


def test_a_word_is_sounded_out_once(monkeypatch):
    from tessera.functions import phonetic

    asked, own = [], phonetic.sounds
    monkeypatch.setattr(phonetic, "sounds", lambda w: asked.append(w) or own(w))
    assert all(phonetic.word_sounds_alike("zizmo", "gizmo zizmo") for _ in range(50)) and asked.count("zizmo") == 1


def test_nodes_of_long_documents_are_handed_on_apart(spark, monkeypatch):
    """Few characters at a time, with documents between that are broken or declare entities."""
    texts = ["<a><b>x</b></a>", "<a><b>", "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>", None, "<!--t--><a k='1'><b/>y<c>z</c></a>"]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "i long, x string").coalesce(1)
    want = sorted(map(str, nodes.import_documents(docs, "i", "x").collect()))
    monkeypatch.setattr(nodes, "CHARACTERS", 10)
    assert sorted(map(str, nodes.import_documents(docs, "i", "x").collect())) == want and len(want) == 3 * (3 + 7)


def test_nodes_by_places_are_those_of_the_parser():
    """Random documents, many of them broken or irregular, alone and beside others, against the parser's events."""
    import random

    import pyarrow as pa

    def by_events(ids, texts):
        out = nodes.Shredder()
        for own, text in zip(ids, texts, strict=True):
            out.add(own, text or "")
        return sorted(map(str, out.batch().to_pylist()))

    rng, texts = random.Random(7), [None, "", "<a>", "<a b='1'/>", '<a b="x>y"/>', "<a>x>y</a>", "<a><!-- > < --></a>", "<a><!-- it's <b> --></a>", "<!----><a/>", "<a>it's</a><!--t-->"]
    texts += ['<a b = "1"\n\tc="2\t3\n"  />', "<a xmlns='u'><b/></a>", "<a>&amp;<![CDATA[x]]></a>", "<p:a/>", "<a b=\"1\" b=\"2\"/>", "<a>\u00a0</a>", "<a>\u200b</a>", "<a>\u3000 \u0085</a>", "<a\n>\r</a >", "<?t?><a/>", "\ufeff<a/>", '<a b="/"/>', '<a b="">"\'"</a>', "<!DOCTYPE a><a/>"]

    def inner(deep):
        parts = []
        for _ in range(rng.randrange(5)):
            name, attributes = rng.choice(["b", "c-d", "\u00e9", "e.1"]), "".join(f"{rng.choice([' ', '  ', chr(10)])}k{i}{rng.choice(['=', ' = '])}{rng.choice(['"v"', '""', '"a b"', '"it/s"', '"\u00fc"'])}" for i in range(rng.randrange(4)))
            tag = f"<{name}{attributes}{rng.choice(['', ' '])}/>" if deep == 0 or rng.random() < 0.3 else f"<{name}{attributes}>{inner(deep - 1)}</{name}{rng.choice(['', ' '])}>"
            parts.append(rng.choice([tag, tag, tag, "x y", " ", "\n", "\u00e4", "<!---->", "<!-- c -->", 'say "so"', "a>b", "&lt;", "<!--a>b-->", "<", "</b>"][: rng.choice([10, 10, 10, 15])]))
        return "".join(parts)

    texts += [f"{rng.choice(['', '<!-- first -->', chr(10)])}<r>{inner(4)}</r>{rng.choice(['', chr(10), '<!--last-->'])}" for _ in range(1500)]
    ids = [None if i % 97 == 5 else i for i in range(len(texts))]
    plain = 0
    for size in (1, 7, len(texts)):
        for at in range(0, len(texts), size):
            own, some = ids[at : at + size], texts[at : at + size]
            found = list(nodes._shred(pa.array(own, pa.int64()), pa.array(some, pa.string())))
            assert sorted(str(x) for b in found for x in b.to_pylist()) == by_events(own, some)
            plain += len(found) == 1
    assert plain > 300


def test_regular_documents_need_no_events(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(nodes, "Shredder", None)
    found = list(nodes._shred(pa.array([1, 2]), pa.array(["<a k=\"1\"><b>x</b><!-- c --></a>", "<a><b></a>"])))
    assert [b.column("name").to_pylist() for b in found] == [["a", "k", "b", None, None]]


def test_numbers_of_texts(spark):
    """As by try_cast; texts without a digit do not get as far as an exception."""
    import time

    texts = ["12", " 7 ", "+3", "-4", "1.5", "x1", "", "A", "9999999999", "\u0661", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert all(a == b for a, b in df.select(nodes.number(F.col("t"), "int"), F.col("t").try_cast("int")).collect())
    many = spark.range(0, 1_000_000, 1, 1).select(F.concat(F.lit("A"), F.chr(F.col("id") % 20 + 66)).alias("t"))
    took = []
    for number in (nodes.number(F.col("t"), "int"), F.col("t").try_cast("int")):
        began = time.monotonic()
        assert many.filter(number >= 48).count() == 0
        took.append(time.monotonic() - began)
    assert took[0] < took[1] / 1.5


def test_a_round_trip_shuffles_texts_only(spark):
    """Orders to one shuffle for both sides; nodes stay where their documents are."""
    from tessera.plans.queries import QUERIES

    done = QUERIES["xml_round_trip"](spark, "/root/testdata/sf0.001")
    assert done.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().count()
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4  # orders, planned once for each side, and the sides of the join


def test_texts_of_whole_documents(monkeypatch):
    """Random documents in batches that part them, some nodes gone, against a plain recursive writer."""
    import random
    from xml.sax.saxutils import escape, quoteattr

    import pyarrow as pa

    rng = random.Random(5)

    def inner(deep):
        parts = []
        for _ in range(rng.randrange(5)):
            attributes = "".join(f" k{i}=" + rng.choice(['"v"', '""', '"it\'s"', "'a&quot;b'", '"&amp;\u00fc&#10;x"', "'say &quot; it&apos;s &lt;'"]) for i in range(rng.randrange(4)))
            attributes += rng.choice(["", "", ' xmlns:p="urn:p" p:k="1" p:l="&quot;"', ' xmlns="urn:q"'])
            name = rng.choice(["b", "c-d", "\u00e9"])
            tag = f"<{name}{attributes}/>" if deep == 0 or rng.random() < 0.3 else f"<{name}{attributes}>{inner(deep - 1)}</{name}>"
            parts.append(rng.choice([tag, tag, tag, "x y", "&lt;&amp;", "\u00e4", "<!-- c<>& -->", "<?pi v<>?>", "<![CDATA[<&]]>", "\n t\t"]))
        return "".join(parts)

    def plain(rows, parent=None):
        out = []
        for r in (x for x in rows if x["parent"] == parent and x["kind"] != "attribute"):
            value = r["value"] or ""
            if r["kind"] != "element":
                out.append({"text": escape(value), "cdata": f"<![CDATA[{value}]]>", "comment": f"<!--{value}-->", "pi": f"<?{r['name']} {value}?>"}[r["kind"]])
                continue
            head = f"<{r['name']}" + (f" xmlns={quoteattr(r['ns'])}" if r["ns"] else "")
            for a in (x for x in rows if x["parent"] == r["pre"] and x["kind"] == "attribute"):
                own = a["ns"] not in (None, "", "xmlns")
                head += (f" xmlns:n{a['pre']}={quoteattr(a['ns'])} n{a['pre']}:" if own else " xmlns:" if a["ns"] else " ") + f"{a['name']}={quoteattr(a['value'] or '')}"
            below = plain(rows, r["pre"])
            out.append(f"{head}>{below}</{r['name']}>" if below or any(x["parent"] == r["pre"] and x["kind"] != "attribute" for x in rows) else f"{head}/>")
        return "".join(out)

    shredder = nodes.Shredder()
    for i in range(300):
        shredder.add(None if i == 299 else 2**53 + i, f"{rng.choice(['', '<!-- f -->', '<?a b?>'])}<r>{inner(3)}</r>{rng.choice(['', '<!--l-->'])}")
    table = shredder.batch()
    table = table.filter(pa.array([k not in ("text", "comment") or rng.random() < 0.7 for k in table["kind"].to_pylist()]))
    want = {}
    for r in table.to_pylist():
        want.setdefault(r["doc_id"], []).append(r)
    want = {i: plain(rows) for i, rows in want.items()}
    for size in (1, 50, table.num_rows):
        found = [r for rows in nodes._whole_documents(table.slice(i, size) for i in range(0, table.num_rows, size)) for out in nodes._texts(rows) for r in out.to_pylist()]
        assert {r["doc_id"]: r["xml"] for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("text", ['<a k="1"><b>x</b><!-- c --></a>', "<a k='1'>&amp;<![CDATA[x]]></a>", "<a><b>", "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>"])
def test_an_import_holds_as_much_for_many_documents_as_for_few(spark, text):
    """A worker keeps no parser and nothing that one left, also while cycles are not looked for."""
    import gc
    import tracemalloc

    import pyarrow as pa

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "xml": [text] * 1000})
    held = {}

    def batches():
        for i in range(13):
            held[i] = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
            yield batch

    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in nodes.import_documents(Docs(), "i", "x")(batches())) % 13 == 0
    finally:
        tracemalloc.stop()
        gc.enable()
    assert held[12] - held[2] < 8 << 20  # a parser is some 13 KB; Python's own table of names may be made anew meanwhile


def test_nodes_are_shuffled_packed_by_document(spark, chart, monkeypatch):
    monkeypatch.setattr(nodes, "written", lambda df: df)
    new = nodes.create_attribute(chart, chart.filter("name = 'name'"), "of", "us")
    for changed in (new, nodes.insert_before(chart, chart.filter("name = 'name'"), "of"), nodes.export_documents(chart)):
        assert "MapInArrow" in changed._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning", 1)[1]


@pytest.mark.parametrize("far", [1, 1 << 40])
def test_packed_nodes_are_the_same(monkeypatch, far):
    monkeypatch.setattr(nodes, "UNPACKED", 60)
    rng = random.Random(3)
    rows = []
    for doc in (None, 1, 2, 7):
        for at in range(rng.choice((1, 9, 30))):
            for turn, name in sorted({(rng.randrange(3), rng.choice((None, "", "a", "b☃"))) for _ in range(3)}, key=lambda x: (x[0], x[1] is not None, x[1] or "")):
                link = lambda: rng.choice((-1, at * far, rng.randrange(99)))  # noqa: B023, E731
                rows.append({"doc_id": doc, "turn": turn, "at": at * far, "last": link(), "parent": link(), "depth": rng.randrange(9), "kind": "text", "name": name, "ns": rng.choice((None, "u")), "value": rng.choice((None, "", "é" * rng.randrange(5)))})
    kinds = {"doc_id": pa.int64(), "turn": pa.int32(), "at": pa.int64(), "last": pa.int64(), "parent": pa.int64(), "depth": pa.int32(), **dict.fromkeys(("kind", "name", "ns", "value"), pa.string())}
    mixed = sorted(rows, key=lambda r: (r["doc_id"] or 0, rng.random()))  # documents stay together, as the shuffle leaves them
    table = pa.table({c: pa.array([r[c] for r in mixed], kind) for c, kind in kinds.items()})
    packed = list(nodes._pack(iter(table.to_batches(max_chunksize=17))))
    assert sum(x.num_rows for x in packed) <= 4 + len(packed)
    got = [r for part in nodes._unpacked(iter(packed)) for r in part.to_pylist()]
    assert got == rows
