"""Properties of the parser and of constant folding over random statements."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from deltaloom.functions.kinds import KINDS, Literal, canonical_json, coerce, wide_bytes, wide_int
from deltaloom.plans.analyzer import All, Any_, Truth, fold
from deltaloom.plans.errors import DialectError
from deltaloom.plans.parser import parse

names = st.from_regex(r"[a-z_][a-z0-9_]{0,6}", fullmatch=True).filter(lambda n: n.upper() not in "SELECT FROM WHERE AND OR ORDER BY LIMIT OFFSET GROUP HAVING JOIN ON AS INNER TRUE FALSE NULL CROSS LEFT RIGHT FULL OUTER NATURAL ALL DISTINCT IS NOT DESC ASC X".split())
literals = st.one_of(st.integers(-(10**25), 10**25).map(str), st.text("ab'\" ", max_size=5).map(lambda t: "'" + t.replace("'", "''") + "'"), st.sampled_from(["TRUE", "0xAB", "1.5e2", ":p"]))
comparisons = st.builds(lambda n, o, v: f"{n} {o} {v}", names, st.sampled_from(["=", "!=", "<>", "<", "<=", ">", ">="]), literals)
terms = st.one_of(comparisons, st.sampled_from(["TRUE", "false"]), names.map(lambda n: f"{n} IS NOT NULL"))
predicates = st.recursive(terms, lambda p: st.one_of(st.builds("({}) AND ({})".format, p, p), st.builds("({}) OR ({})".format, p, p), p.map("({})".format)), max_leaves=8)


@given(names, predicates, st.integers(0, 9), st.booleans())
@settings(max_examples=150, deadline=None)
def test_white_space_case_and_parentheses_do_not_matter(table, where, limit, star):
    sql = f"SELECT {'*' if star else 'a1, b1 AS c1'} FROM {table} WHERE {where} LIMIT {limit}"
    one = parse(sql)
    keyword = lambda m: m[0].lower()
    parts = re.split(r"('(?:[^']|'')*')", sql)
    other = "".join(p if i % 2 else re.sub(r"\b(SELECT|FROM|WHERE|AND|OR|LIMIT|TRUE|IS|NOT|NULL)\b", keyword, p).replace(" ", "\n\t ") for i, p in enumerate(parts))
    assert parse(other.replace("where", "WHERE (", 1).replace("\n\t limit", ")\n limit", 1) + " ;") == one


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_is_a_statement_or_an_error(text):
    for sql in (text, f"SELECT * FROM t WHERE {text}"):
        try:
            parse(sql)
        except DialectError:
            pass


trees = st.recursive(st.one_of(st.booleans().map(Truth), st.sampled_from("abc")), lambda t: st.builds(lambda k, x: k(tuple(x)), st.sampled_from([All, Any_]), st.lists(t, min_size=1, max_size=3)), max_leaves=10)


def value(e, given_):
    if isinstance(e, Truth):
        return e.value
    if isinstance(e, str):
        return given_[e]
    return (all if isinstance(e, All) else any)(value(t, given_) for t in e.terms)


@given(trees, st.fixed_dictionaries({c: st.booleans() for c in "abc"}))
@settings(max_examples=300, deadline=None)
def test_folding_keeps_the_meaning(tree, given_):
    folded = fold(tree)
    assert value(folded, given_) == value(tree, given_)
    assert not isinstance(folded, (All, Any_)) or not any(isinstance(t, (Truth, type(folded))) for t in folded.terms)


@given(st.sampled_from([k for k in KINDS.values() if k.integer]), st.integers(-(1 << 257), 1 << 257))
@settings(max_examples=200, deadline=None)
def test_integers_fit_their_kind_or_are_refused(kind, n):
    lo, hi = kind.range
    try:
        got = coerce(Literal("int", n, str(n)), kind)
        assert lo <= n <= hi and (wide_int(got, kind) if kind.wide else got) == n
        assert not kind.wide or n == hi or wide_bytes(n + 1, kind) > got
    except DialectError:
        assert not lo <= n <= hi


values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=4)), lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.text(max_size=3), v, max_size=3)), max_leaves=8)


@given(values)
@settings(max_examples=200, deadline=None)
def test_canonical_json_is_stable(v):
    import json

    one = canonical_json(json.dumps(v))
    assert canonical_json(one) == one == canonical_json(json.dumps(v, indent=3, ensure_ascii=False))
    assert json.loads(one) == v
