from muster.operators import links
from muster.sources import tables

TYPES = ("Household", "Family")
SCHEMA = "src string, dst string, link_type string, source string"


def existing(spark):
    return spark.createDataFrame([("b", "a", "Family", "data"), ("c", "d", "Family", "data")], SCHEMA)


def accounts(spark):
    return spark.createDataFrame([(x,) for x in "abcdef"], "id string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_link_keeps_direction_and_changes_type(spark):
    pairs = spark.createDataFrame([
        (1, "a", "b", "Household"), (2, "e", "f", "Family"), (3, "f", "e", "Household"),
        (4, "a", "a", "Family"), (5, "a", "zz", "Family"), (6, "a", "c", "Rival"), (7, "a", "c", None)],
        "seq int, a string, b string, link_type string")
    done = links.link(existing(spark), pairs, accounts(spark), "id", TYPES)
    assert rows(done.links) == [("b", "a", "Household", "user"), ("c", "d", "Family", "data"),
                                ("e", "f", "Household", "user")]
    assert sorted((r.seq, r.reason) for r in done.rejected.collect()) == [
        (4, "self link"), (5, "unknown account"), (6, "unknown type"), (7, "unknown type")]


def test_group_links_to_the_first(spark):
    groups = spark.createDataFrame([(1, ["a", "b", "a", "c"], "Family"), (2, ["d", "d"], "Family")],
                                   "seq int, accounts array<string>, link_type string")
    none = existing(spark).where("false")
    done = links.link_group(none, groups, accounts(spark), "id", TYPES)
    assert [(r[0], r[1]) for r in rows(done.links)] == [("a", "b"), ("a", "c")]
    assert [r.reason for r in done.rejected.collect()] == ["fewer than two accounts"]


def test_unlink_either_direction(spark):
    pairs = spark.createDataFrame([("a", "b"), ("e", "f")], "a string, b string")
    done = links.unlink(existing(spark), pairs)
    assert rows(done.links) == [("c", "d", "Family", "data")]
    assert rows(done.removed) == [("b", "a", "Family", "data")]
    assert rows(done.missing) == [("e", "f")]


def test_log_is_replayed_in_order(spark):
    ops = spark.createDataFrame([
        (1, "link", "a", "b", "Household"), (2, "unlink", "b", "a", None), (3, "link", "a", "b", "Family"),
        (4, "link", "b", "a", "Household"), (5, "link", "e", "f", "Family"), (6, "unlink", "e", "f", None),
        (7, "link", "d", "c", "Household")], "seq int, action string, a string, b string, link_type string")
    got = rows(links.apply_link_log(existing(spark), ops, accounts(spark), "id", TYPES).links)
    assert got == [("a", "b", "Household", "user"), ("c", "d", "Household", "user")]


def test_log_skips_what_a_direct_link_refuses(spark):
    ops = spark.createDataFrame([
        (1, "link", "a", "a", "Family"), (2, "link", "a", "zz", "Family"), (3, "link", "e", "f", "Nonsense"),
        (4, "unlink", "e", "zz", None), (5, "link", "e", "f", "Family")],
        "seq int, action string, a string, b string, link_type string")
    done = links.apply_link_log(existing(spark).where("false"), ops, accounts(spark), "id", TYPES)
    assert rows(done.links) == [("e", "f", "Family", "user")]
    assert sorted((r.seq, r.reason) for r in done.rejected.collect()) == [
        (1, "self link"), (2, "unknown account"), (3, "unknown type")]


def test_links_carry_their_time(spark):
    old = existing(spark).selectExpr("*", "'2020' AS created_at")
    pairs = spark.createDataFrame([(1, "a", "b", "Family", "2021"), (2, "b", "a", "Family", "2022"),
                                   (3, "e", "f", "Family", "2023")], "seq int, a string, b string, link_type string, at string")
    done = links.link(old, pairs, accounts(spark), "id", TYPES).links
    assert rows(done.select("src", "dst", "created_at")) == [("b", "a", "2022"), ("c", "d", "2020"), ("e", "f", "2023")]
    fresh = links.link(existing(spark), pairs, accounts(spark), "id", TYPES).links
    assert sorted((r.src, r.created_at) for r in fresh.collect()) == [("b", "2022"), ("c", None), ("e", "2023")]


def test_upsert_overwrites_listed_columns_only(spark):
    target = spark.createDataFrame([(1, "x", 10), (2, "y", 20)], "id int, name string, n int")
    new = spark.createDataFrame([(1, 1, None), (1, 0, 5), (3, 0, 7)], "id int, seq int, n int")
    assert rows(tables.upsert(target, new, "id", "seq")) == [(1, "x", None), (2, "y", 20), (3, None, 7)]


def test_edges_need_both_ends(spark):
    edges = spark.createDataFrame([("a", "b", 1, 1), ("a", "b", 9, 0), ("a", "zz", 1, 0), ("b", "a", 3, 2)],
                                  "src string, dst string, calls int, seq int")
    load = tables.load_edges(edges, accounts(spark), "id", accounts(spark), "id", "seq")
    assert rows(load) == [("a", "b", 1), ("b", "a", 3)]
    both = tables.load_edges(edges, accounts(spark), "id", accounts(spark), "id", "seq", undirected=True)
    assert rows(both) == [("a", "b", 3)]
    first = tables.load_edges(edges.where("calls = 3 or seq = 9"), accounts(spark), "id", accounts(spark), "id", "seq",
                              undirected=True)
    assert rows(first) == [("b", "a", 3)]


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert rows(tables.duplicate_keys(df, "id")) == [(1, 2)]
