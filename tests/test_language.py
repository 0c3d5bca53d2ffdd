import pytest
from cases import BAD_TAGS, COMPILED, GOOD_TAGS, NOT_COMPILED, NOT_POSTFIX
from hypothesis import given
from hypothesis import strategies as st

from tagloom import QueryError, compile_infix, compile_postfix, compile_query, lex, parse_line, parse_tag
from tagloom.model import Tag


@pytest.mark.parametrize("text,ns,key,value", GOOD_TAGS)
def test_good_tags(text, ns, key, value):
    assert parse_tag(text) == Tag(ns, key, value)


@pytest.mark.parametrize("text", BAD_TAGS)
def test_bad_tags(text):
    with pytest.raises(QueryError):
        parse_tag(text)


@pytest.mark.parametrize("infix,postfix", COMPILED)
def test_compiled(infix, postfix):
    assert compile_infix(infix) == postfix
    assert compile_postfix(postfix).program == compile_query(infix).program


@pytest.mark.parametrize("text", NOT_COMPILED)
def test_not_compiled(text):
    with pytest.raises(QueryError):
        compile_infix(text)


@pytest.mark.parametrize("text", NOT_POSTFIX)
def test_not_postfix(text):
    with pytest.raises(QueryError):
        compile_postfix(text)


def test_operator_scan():
    atom = compile_query("temp<-5").program[0]
    assert (atom.key, atom.op, atom.value) == ("temp", "<", "-5")
    assert compile_query('"a>b"!="="').program[0].value == "="


def test_bare_tokens():
    assert all(map(lex.is_token, ["a", "-1", "+1", "2.0.0-rc1", "_", "1.0.0+build.5", "++"]))
    assert not any(map(lex.is_token, ["", "+", "*", ".a", "a b", "a:b", '"a"', "é", "a\n"]))


def test_lines():
    assert parse_line("x　k=1 \tns:b") == ("x", [Tag(None, "k", "1"), Tag("ns", "b", None)])
    assert parse_line("only") == ("only", [])
    with pytest.raises(QueryError):
        parse_line("   ")
    # U+001C isn't white space here, though Python's str.isspace says so.
    assert lex.split_fields("a\x1cb c") == ["a\x1cb", "c"]


@given(st.text(max_size=20), st.text(max_size=20), st.text(max_size=20))
def test_quoted_round_trip(ns, key, value):
    q = lambda s: '"' + s.replace('"', '""') + '"'
    assert parse_tag(f"{q(ns)}:{q(key)}={q(value)}") == Tag(ns, key, value)
    assert compile_postfix(f"{q(ns)}:{q(key)}={q(value)}").program[0].value == value


def test_long_texts():
    assert parse_tag('k="' + "a" * 500_000 + '"').value == "a" * 500_000
    assert len(compile_query(" or ".join(["a"] * 5_000)).program) == 9_999
    assert len(compile_query("not " * 5_000 + "a").program) == 5_001
