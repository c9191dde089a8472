import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landshift.llm import chat
from landshift.llm.templates import Node, TemplateError, compiled, folded, parsed

FORM = chat.ChatFormat()


def _brute(rows, form=FORM):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0], r[1] or 0, r[2].encode(), r[3].encode()))
        said = "".join(f"{r}\n{t}\n" for *_, r, t in held)
        loss = "".join(t for *_, r, t in held if r == "assistant")
        size = sum(len(form.begin + form.escape(r) + form.named + form.escape(t) + form.end) for *_, r, t in held)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((str(conv), len(held), sha(said), len(loss), sha(loss), size))
    return sorted(out)


def _got(df):
    return sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in df.collect())


HARD = ["\\### Assistant: </turn> ok", "### ", "</turn>\n", ":\n", "a:\n### b</turn>", "\\", "\\\\</turn>", "####  ", "</turn></turn>\n", "", None, "é\U0001f600", "ends with \\", "x" * 200_000]


def _rows():
    rng = random.Random(3)
    rows = [(i, k, rng.choice(["user", "assistant", "system", "", None, "ro:\nle", "\\"]), rng.choice(HARD)) for i in range(40) for k in range(rng.randint(1, 9))]
    rows += [(500, k, "assistant" if k % 2 else "user", f"turn {k} </turn>") for k in range(3000)]  # more than a part
    rows += [(600, 1, "user", "same"), (600, 1, "user", "same"), (600, 1, "assistant", "same"), (600, None, "system", "first"), (None, 0, "user", "no id"), (None, 1, "assistant", "no id")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("form", [FORM, chat.ChatFormat(part_turns=1), chat.ChatFormat(part_chars=50)])
def test_round_trip_against_brute_force(spark, form):
    rows = [r for r in _rows() if form is FORM or r[0] != 500 or r[1] < 40]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, mask int").repartition(5)
    assert _got(chat.chat_report(df, form)) == _brute(rows)


def test_empty_table(spark):
    assert chat.chat_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_head_tail_and_mask_over_parts(spark):
    form = chat.ChatFormat(source="<conversation>\n" + chat.SOURCE.replace("{{ end }}", "{{ end }}{% if loop.last %}done\n{% endif %}") + "</conversation>", part_turns=2)
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(5)] + [(2, 0, "assistant", "only")]
    parts = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), form).orderBy("conv_id", "part").collect()
    text = {i: "".join(r.text for r in parts if r.conv_id == i) for i in (1, 2)}
    turn = lambda r, t: f"### {r}:\n{t}</turn>\n"
    assert text[1] == "<conversation>\n" + "".join(turn(r, t) for _, _, r, t in rows[:5]) + "done\n</conversation>"
    assert text[2] == "<conversation>\n" + turn("assistant", "only") + "done\n</conversation>"
    assert ["".join(r.text[m.start : m.end] for r in parts if r.conv_id == i for m in r["mask"]) for i in (1, 2)] == ["t1t3", "only"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:\n", "\\"]), st.text(alphabet=st.sampled_from(list("\\#: \n</turn>aé")), max_size=30)), max_size=5))
def test_any_turns_come_back(messages):
    out = FORM.compiled().render([{"role": r, "text": t} for r, t in messages])
    assert chat.turns(out.text(), FORM) == messages
    assert [chat.unescaped(out.text()[s:e]) for s, e in out.spans] == [t for r, t in messages if r == "assistant"]
    assert out.size == len(out.text())


def _render(source, messages=({"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}), **constants):
    return compiled(source, constants).render(list(messages)).text()


@pytest.mark.parametrize(
    "source, want",
    [
        ("a{% for m in messages %}[{{ m.role }}]{% endfor %}z", "a[user][assistant]z"),
        ("{% for m in messages %}{{ m['text'] | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", "HI, YO"),
        ("{% for m in messages %}{% if m.role == 'user' %}U{% elif m.role == 'assistant' %}A{% else %}?{% endif %}{% endfor %}", "UA"),
        ("{% for m in messages %}{% if loop.first and m.text in 'ohio' or false %}x{% else %}y{% endif %}{% endfor %}", "xy"),
        ("{% for m in messages -%}  \n {{ 'a' + \"b\\n\" + name }} {# gone #}{%- endfor %}", "ab\nN ab\nN "),
        ("{{ none }}{{ true }}{% for m in messages %}{{ (m.text + '!') | trim }}{% endfor %}", "truehi!yo!"),
        ("{% for m in messages %}{{ not not m.text == 'hi' }}{% endfor %}", "truefalse"),
    ],
)
def test_what_templates_say(source, want):
    assert _render(source, name="N") == want


def test_constants_are_folded():
    tree = lambda source: folded(parsed(source), {"n": "x"}, {"up": str.upper})
    assert tree("a{{ 'b' + n }}{{ n | up }}c") == Node("seq", None, (Node("text", "abxXc"),))
    assert tree("{% if n == 'x' and not false %}yes{% else %}{{ n }}{% endif %}!") == Node("seq", None, (Node("text", "yes!"),))
    kept = tree("{% for m in messages %}{% if true and m.a %}{{ 'a' + 'b' }}{% endif %}{% endfor %}")
    assert kept.parts[0].parts[0].parts[0] == Node("field", ("m", "a")) and kept.parts[0].parts[0].parts[1].parts == (Node("text", "ab"),)


@pytest.mark.parametrize(
    "source",
    [
        "no loop", "{% for m in messages %}", "{% endfor %}", "{% for m in other %}{% endfor %}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}",
        "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{% for m in messages %}{{ open('x') }}{% endfor %}", "{% for m in messages %}{{ m.text | eval }}{% endfor %}",
        "{% for m in messages %}{{ x }}{% endfor %}", "{% import os %}{% for m in messages %}{% endfor %}", "{{ m.text }}{% for m in messages %}{% endfor %}",
        "{% for m in messages %}{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}{% endfor %}", "{% for m in messages %}{% if a %}{% endfor %}{% endif %}",
        "{% for m in messages %}{{ " + "(" * 60 + "'a'" + ")" * 60 + " }}{% endfor %}", "{% for m in messages %}{{ 'a }}{% endfor %}", "{% for m in messages %}{{ loop.index.x }}{% endfor %}", "x" * 100_001,
    ],
)
def test_what_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        compiled(source)
