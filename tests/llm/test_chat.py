import hashlib
import random

import pytest

from weft.llm.chat import PROBE, TEMPLATE, format_chats, read_chats
from weft.llm.template import CONTROLS, Template, TemplateError, escape, unescape


def test_escape_round_trip():
    r = random.Random(2)
    parts = [*CONTROLS, "\\", "<", "|", ">", "[", "/", "s>", "INST]", "x", "\n", "é", "<|end|>", "\\\\"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        safe = escape(text)
        assert unescape(safe) == text and not any(c in safe for c in CONTROLS)


def test_language():
    t = Template("{# c #}{% set n = 1 + 2 %}{{ n }} {%- if n == 3 and not false %} yes {% else %}no{% endif -%}   {% for x in xs %}{{ loop.index }}{{ x.a ~ '!' }}{% if not loop.last %},{% endif %}{% endfor %}{{ ' Ab ' | trim | upper }}")
    assert t.render([], xs=[{"a": 1}, {"a": "b"}])[0] == "3 yes 11!,2b!AB"
    assert Template("{% if 1 == 1 %}a{{ 'b' ~ 1 }}{% else %}{{ x }}{% endif %}c").tree == [("text", "ab1c")]
    assert Template("x{% generation %}ab{{ 'c' }}{% endgeneration %}y").render([]) == ("xabcy", [(1, 4)])
    assert Template("{{ messages[0]['role'] }}{% for m in messages %}{{ m.role }}{% endfor %}").render([{"role": "u"}, {"role": "v"}])[0] == "uuv"


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ open('x') }}", "{% import os %}", "{{ x | eval }}", "{% if a %}", "{{ 1 + }}", "{{ _x }}"])
def test_sandbox(bad):
    with pytest.raises(TemplateError):
        Template(bad)


def test_no_python_attributes():
    with pytest.raises(TemplateError):
        Template("{{ x.upper }}").render([], x="s")


def brute(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        rows = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        loss = "".join(x or "" for _, _, r, x in rows if r == "assistant")
        sha = hashlib.sha256("".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in rows).encode()).hexdigest()
        out[conv] = (len(rows), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    parts = [*CONTROLS, "\\", "héllo ", "<|end|>\n", "\n", "😀"]
    turns = [(c, t, r.choice(["user", "assistant", "system", None, "<|x|>"]), r.choice([None, ""] + ["".join(r.choice(parts) for _ in range(9))] * 6)) for c in range(30) for t in range(r.randint(1, 6))]
    turns += [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE), (None, 1, "user", "a"), (None, None, "assistant", "b"), (7, 1, "user", "same"), (7, 1, "user", "same")]
    turns += [(99, k, ("user", "assistant")[k % 2], "long " * 50) for k in range(500)]
    df = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, chunk int").repartition(5)
    got = {g.conv_id: g for g in read_chats(format_chats(df, chunk_chars=3000)).collect()}
    assert {k: tuple(g)[1:5] for k, g in got.items()} == brute(turns)
    assert got[-1].formatted_chars == len(Template(TEMPLATE).render([{"role": "user", "text": PROBE}, {"role": "assistant", "text": PROBE}])[0])
    assert read_chats(format_chats(df.limit(0))).count() == 0
