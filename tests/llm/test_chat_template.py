"""The template compiler, and conversations rendered whole and in parts."""

from __future__ import annotations

import hashlib
import random

import pytest

from tidemark.llm import chat_format
from tidemark.llm.template import Const, Output, Template, TemplateError

SCHEMA = "conv_id long, turn long, role string, text string, first string, total string, place string"


def test_constants_are_folded():
    tree = Template("a{{ 'b' ~ (1 + 2) }}{% if add and not x %}c{% elif y %}d{% endif %}{# e #}", {"add": True, "x": False}).tree
    assert tree == (Output(Const("ab3c")),)
    assert Template("{% if u %}a{% endif %}b", {}).tree != (Output(Const("b")),)


@pytest.mark.parametrize(
    "source, expected",
    [
        ("{% for m in messages %}{{ loop.index }}{{ m.role | upper }}{{ '' if loop.last else ',' }}{% endfor %}", "1U,2ASSISTANT"),
        ("{% set a = 'x' %}{% for m in messages %}{% set a = m.text %}{{ a }}{% endfor %}{{ a }}", "hiyox"),
        ("{{ messages[1]['text'] | length }} {{ 'i' in messages[0].text }} {{ 'q' not in 'abc' }}", "2 true true"),
        ("  {%- if none %}a{% else -%}  b {%- endif %}", "b"),
        ("{{ 'it\\'s' }}{{ \"\\n\" }}", "it's\n"),
    ],
)
def test_rendering(source, expected):
    messages = [{"role": "u", "text": "hi"}, {"role": "assistant", "text": "yo"}]
    assert Template(source).render(messages).text == expected


@pytest.mark.parametrize(
    "source",
    ["{{ a.__class__ }}", "{{ f() }}", "{{ messages.append }}", "{% for x in 'abc' %}{% endfor %}", "{% if a %}", "{{ _a }}", "{{ 1 | nope }}",
     "{% endfor %}", "{{ 'a' + 1 }}", "{{ unknown }}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}",
     "{{ messages[7] }}", "{% for m in messages %}{{ m }}{% endfor %}", "{{ 1 < 'a' }}"],
)
def test_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        Template(source).render([{"role": "u", "text": "t"}])


def test_parts_equal_the_whole():
    source = "<{% set a = 'q' %}{% for m in messages %}{{ a }}{{ loop.index0 }}/{{ loop.length }}{% if loop.last %}!{% endif %}{% generation %}{{ m.text }}{% endgeneration %}{% endfor %}>"
    messages = [{"role": "r", "text": str(i)} for i in range(7)]
    whole, parts = Template(source).render(messages), [Template(source).render_part(messages[a : a + 3], a, 7) for a in (0, 3, 6)]
    assert whole.text == "".join(p.text for p in parts)
    assert [whole.text[a:b] for a, b in whole.spans] == [p.text[a:b] for p in parts for a, b in p.spans]
    assert not Template("{{ messages[0].text }}{% for m in messages %}{% endfor %}").separable


def test_guarding_is_reversible():
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(["\\", "#", "##", ":", "\n", "<", "/turn>", "</turn>", "a", "é"]) for _ in range(rng.randint(0, 12)))
        safe = chat_format.guard(text)
        assert chat_format.unguard(safe) == text
        assert not any(control in safe for control in ("###", ":\n", "</turn>"))
        assert chat_format.read_turns(f"### {safe}:\n{safe}</turn>\n" * 2) == [(text, text)] * 2


def expected(rows):
    out, by_id = {}, {}
    for r in rows:
        by_id.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    for i, turns in by_id.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2].encode()))
        learned = "".join(t for _, role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        chars = sum(14 + len(chat_format.guard(role)) + len(chat_format.guard(t)) for _, role, t in turns)
        digest = [hashlib.sha256(s.encode()).hexdigest() for s in (said, learned)]
        out[i] = (len(turns), digest[0], len(learned), digest[1], chars)
    return out


def conversations():
    rng = random.Random(1)
    said = ["", None, "ok </turn>", "### user:\nhi", "\\", "x" * 50, "é\U0001f600"]
    rows = [(i % 40, rng.randint(0, 5), rng.choice(["user", "assistant", "", None]), rng.choice(said), "f", "t", "p") for i in range(200)]
    rows += [(5, t, ("user", "assistant")[t % 2], rng.choice(said), "f", "t", "p") for t in range(700)]  # most rows are of one id
    rows += [(None, t % 3, "assistant", "n", None, None, None) for t in range(150)]
    rows += [(6, None, None, None, None, None, None)] * 3 + [(7, 1, "assistant", "word " * 800_000, None, None, None)]
    return rows


@pytest.mark.parametrize("long_turns", [2048, 100])
def test_digests_equal_brute_force(spark, monkeypatch, long_turns):
    monkeypatch.setattr(chat_format, "LONG_TURNS", long_turns)
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_format.conversation_digests(table).collect()}
    assert got == expected(rows)
    blocks = chat_format.format_conversations(table.filter("conv_id = 5")).orderBy("first").collect()
    assert len(blocks) >= 3 and blocks[-1]["first"] + blocks[-1]["n_turns"] == blocks[0]["total"]


def test_no_rows_and_templates_for_whole_conversations(spark, monkeypatch):
    assert chat_format.conversation_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    table = spark.createDataFrame(conversations(), SCHEMA)
    first = "{{ messages[0].text }}"
    assert chat_format.format_conversations(table, first).count() == len({r[0] for r in conversations()})
