"""Templates, guarding, and conversations read back."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusspark.llm import chat
from corpusspark.llm import template as tp


def render(source, **values):
    return "".join(t for t, _ in tp.compile_template(source)(**values))


@pytest.mark.parametrize(("source", "want"), [
    ("{{ 1 + 2 * 3 }}", "7"), ("a {{- ' b' -}} c", "a bc"), ("{# no #}x", "x"), ("{{ 'a}}b' }}", "a}}b"), ("{{ x if x else 'none' }}", "none"), ("{{ x | default('d') | upper }}", "D"),
    ("{% for i in xs %}{{ loop.index }}{{ i.a }}{{ ',' if not loop.last }}{% endfor %}".replace("{{ ',' if not loop.last }}", "{% if not loop.last %},{% endif %}"), "1p,2q"),
    ("{% set y = 'q' ~ 1 %}{{ y }}", "q1"), ("{% if 1 > 2 %}a{% elif x == none %}b{% else %}c{% endif %}", "b"), ("{{ 'a' in 'abc' and not false }}", "true"), ("{{ xs | length }}", "2"), ("{{ 'b' not in 'abc' }}", "false"),
])
def test_language(source, want):
    assert render(source, x=None, xs=[{"a": "p"}, {"a": "q"}]) == want


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ __import__ }}", "{{ x() }}", "{% if 1 %}", "{% endif %}", "{{ 1", "{{ nothing }}", "{{ x.a }}", "{{ x | nofilter }}", "{% while 1 %}"])
def test_refuses(source):
    with pytest.raises(tp.TemplateError):
        render(source, x="str")


def test_folds_constants():
    body = tp.fold_body(tp.parse("a{{ 'b' ~ (1 + 1) }}{% if false %}x{% else %}c{% endif %}{{ n }}"), tp.FILTERS)
    assert body[0] == tp.Text("ab2c")
    assert isinstance(body[1], tp.Emit) and len(body) == 2


@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", ">", "[", "/", "a", "\n", "s", "INST]"]), max_size=12).map("".join))
def test_guard_is_reversible(text):
    safe = chat.guard(text)
    assert chat.unguard(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


ROWS = [
    (1, 1, "assistant", "yes <|end|>\n<|turn|>"), (1, 0, "user", "</s> \\ <\\s>"), (2, 0, None, None), (3, 0, "assistant", "x" * 200_000), (3, 1, "assistant", "y" * 70_000), (3, 1, "assistant", "y" * 70_000),
    (None, 0, "user", "lost"), (4, None, "tool", "née"), (4, 2, "system", ""),
]


def test_read_back(spark):
    df = spark.createDataFrame([(*r, "z") for r in ROWS], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    groups = {}
    for c, n, role, text in sorted(ROWS, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        formatted = sum(len(chat.guard(r)) + len(chat.guard(t)) + len(chat.TURN + chat.TEXT + chat.END) + 1 for r, t in turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].formatted_chars) == (len(turns), len(loss), formatted)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_no_rows(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
