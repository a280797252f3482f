import json
import sys

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.nested import flat_tables, nested_triples, node_attribute_rows, pivoted, record_triples, triples


def walk(root):
    """Brute force: (node_no, parent_no, tag, attrs) in document order."""
    out, stack = [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        no = len(out)
        attrs = node.get("attrs")
        out.append((no, parent, node.get("tag"), attrs if isinstance(attrs, dict) else {}))
        children = node.get("children")
        children = children if isinstance(children, list) else [children]
        stack += [(c, no) for c in reversed(children) if isinstance(c, dict)]
    return out


def from_triples(text):
    got = triples(text)
    return [
        (n, p, next((v for m, _, path, v in got if m == n and path == "tag"), None), {path[6:] for m, _, path, _ in got if m == n and path.startswith("attrs.")})
        for n, p, path, _ in got
        if path == ""
    ]


scalar = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8)
attrs = st.none() | st.text(max_size=3) | st.dictionaries(st.text(max_size=4), scalar | st.lists(scalar, max_size=2), max_size=3)
tree = st.recursive(
    st.fixed_dictionaries({"tag": st.text(max_size=4)}, optional={"attrs": attrs, "line": st.integers()}),
    lambda c: st.fixed_dictionaries({"tag": st.text(max_size=4)}, optional={"attrs": attrs, "text": scalar, "children": st.none() | c | st.lists(c | scalar, max_size=3)}),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(tree, st.booleans(), st.booleans())
def test_triples_match_brute_force(root, ascii_only, spaced):
    text = json.dumps(root, ensure_ascii=ascii_only, indent=1 if spaced else None)
    assert from_triples(text) == [(n, p, t, set(a)) for n, p, t, a in walk(root)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='{}[]",:0123456789.eE+-truefalsn \\u', max_size=12))
def test_validity_is_that_of_json(text):
    def fail(_):
        raise ValueError

    for whole in ('{"a": ' + text + "}", '{"a": [' + text + "]}"):
        try:
            json.loads(whole, parse_constant=fail)
            valid = True
        except ValueError:
            valid = False
        assert (nested_triples(whole) is not None) == valid


def test_very_deep_and_cut_off():
    depth = 50_000
    text = '{"tag":"a","children":' * depth + "null" + "}" * depth
    assert sum(path == "" for _, _, path, _ in triples(text)) == depth
    assert triples(text[:-1]) == [] and triples("") == [] and triples(None) == [] and triples("[1]") == [] and triples("3") == []
    assert sys.getrecursionlimit() < depth


def test_rows(spark):
    text = '{"children": {"tag": "b", "attrs": {"x": null, "x": 1, "attrs.y": {"z": [1]}}}, "tag": "a", "attrs": {}}'
    df = spark.createDataFrame([(1, text, "q"), (1, text, "q"), (2, None, "q"), (3, "{", "q"), (None, '{"tag": null}', "q")], "id bigint, tree string, node_no string")
    got = sorted(tuple(str(x) for x in r) for r in node_attribute_rows(df, "id", "tree").collect())
    assert got == [("1", "0", "-1", "a", ""), ("1", "1", "0", "b", ""), ("1", "1", "0", "b", "attrs.y"), ("1", "1", "0", "b", "x"), ("None", "0", "-1", "None", "")]
    values = {r["path"]: r["value"] for r in record_triples(df.filter("id = 1"), "id", "tree").collect() if r["node_no"] == 1}
    assert values["attrs.attrs.y"] == '{"z": [1]}'
    assert node_attribute_rows(df.limit(0), "id", "tree").count() == 0


def test_tables_of_any_shape(spark):
    """Objects in arrays are rows of a table named by the path; all else is a path within its row."""
    text = """{"id": 7, "meta": {"a": {"b": 1}, "tags": ["x", null, [2, {"y": 3}]]},
      "orders": [{"no": 1, "lines": [{"sku": "p", "note": null}, {"sku": "q", "size": {"w": 2}}]}, {"no": 2, "lines": {"sku": "alone"}}, 5]}"""
    df = spark.createDataFrame([(1, text), (2, '{"orders": []}'), (3, '{"orders": [{"no": 3}]'), (4, '{"a" : {}, "b": [ ]} ')], "id bigint, t string")
    t = record_triples(df, "id", "t", (), ())
    root = {r["id"]: r for r in pivoted(t, "id", "", {"no": "id"}, {"meta": "meta."}).collect()}
    assert set(root) == {1, 2, 4} and root[1]["no"] == "7" and root[1]["meta"]["a.b"] == "1" and root[1]["others"] == {"orders[]": "5"}
    assert [r["value"] for r in t.filter("path = 'meta.tags[]'").orderBy("ordinal").collect()] == ["x", None, '[2, {"y": 3}]']
    orders = [(r["id"], r["node_no"], r["parent_no"], r["no"], r["others"]) for r in pivoted(t, "id", "/orders", {"no": "no"}, {}).orderBy("node_no").collect()]
    assert orders == [(1, 0, 0, "1", {}), (1, 1, 0, "2", {"lines.sku": "alone"})]
    lines = [(r["parent_no"], r["node_no"], r["sku"], r["others"]) for r in pivoted(t, "id", "/orders/lines", {"sku": "sku"}, {}).orderBy("node_no").collect()]
    assert lines == [(0, 0, "p", {"note": None}), (0, 1, "q", {"size.w": "2"})]
    trees = record_triples(df, "id", "t", ("orders",), ())
    assert pivoted(trees, "id", "", {"no": "no"}, {}).filter("id = 1").count() == 3


def test_no_field_is_lost(spark):
    text = '{"tag": "a", "line": 3, "more": {"x": true}, "list": [{"k": 1}], "children": [{"tag": "b", "attrs": [1]}]}'
    df = spark.createDataFrame([(1, text)], "id bigint, tree string")
    got = {r["node_no"]: r["others"] for r in flat_tables(df, "id", "tree").collect()}
    assert got == {0: {"line": "3", "more.x": "true"}, 1: {"attrs": "[1]"}}
    assert pivoted(record_triples(df, "id", "tree"), "id", "/list", {"k": "k"}, {}).first()["k"] == "1"
