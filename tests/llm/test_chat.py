import hashlib
import random

import pytest

from parlance.llm import chat_format as cf
from parlance.llm import chat_template as ct


def rendered(source, **variables):
    return "".join({ct.BEGIN: "<<", ct.END: ">>"}.get(p, p) for p in ct.compile_template(source)(variables))


@pytest.mark.parametrize(
    "source,want",
    [
        ("a{# no #}b{{ 'c' + \"d\" }}{{ 1 + 2 }}", "abcd3"),
        ("{% for m in ms %}{{ loop.index }}{{ m.role }}{{ ',' if not loop.last else '.' }}{% endfor %}", "1u,2v."),
        ("{% if x == 'q' and not y %}1{% elif x in 'xyz' %}2{% else %}3{% endif %}", "2"),
        ("{% set a = x | upper %}{{ a ~ none ~ true }}", "XTrue".replace("True", "true")),
        ("{% generation %}{{ ms | length }}{% endgeneration %}!", "<<2>>!"),
        ("{{ z | default('d') }}{{ ms.upper }}{{ x.upper }}{{ x['__class__'] }}", "d"),
        ("{% if 1 < 2 %}yes{% else %}{{ x }}{% endif %}{{ 'a\\n' | trim }}", "yesa"),
        ("{{ (x == 'x') and 'T' or 'F' }}{{ x | replace('x', '}') }}", "T}"),
        ("", ""),
        ("{{ '}}' }}{{ '%}' }}{# {{ #}{% if '{%' in '{%}' %}!{% endif %}", "}}%}!"),
        ("a  {{- 'b' -}}  c\n {%- if true -%} d {%- endif %} e", "abcd e"),
        ("{{ 'q' not in 'xyz' }}{{ u is defined }}{{ x is defined }}{{ ms[0].role is defined }}{{ ms[9] is not defined }}{{ u is none }}", "truefalsetruetruetruetrue"),
        ("{{ ms[1:][0].role }}{{ ms[-1]['role'] }}{{ 'abc'[::-1] }}{{ 'abcd'[1:3] }}{{ [1, 2] | length }}{{ 7 % 4 * 2 }}", "vvcbabc26"),
        ("{{ ' a,b '.strip().split(',') | join('+') }}{{ x.startswith('x') }}{{ ms[0].get('k', 'd') }}", "a+btrued"),
        ("{% set ns = namespace(n=0, last='') %}{% for m in ms %}{% set ns.n = ns.n + 1 %}{% set ns.last = m.role %}{% endfor %}{{ ns.n }}{{ ns.last }}", "2v"),
        ("{{ ms | tojson }}", '[{"role": "u"}, {"role": "v"}]'),
    ],
)
def test_language(source, want):
    assert rendered(source, ms=[{"role": "u"}, {"role": "v"}], x="x", y=True) == want


def test_constants_are_folded():
    tree = ct.fold_body(ct.parse("a{{ 'b' ~ 1 }}{% if false or 2 > 1 %}c{% endif %}{{ x if true else y }}"), ct.FILTERS)
    assert tree == (("text", "ab1c"), ("out", ("name", "x")))


@pytest.mark.parametrize("source", ["{% if x %}", "{% for a in b %}{% endif %}", "{{ a b }}", "{{ f(x) }}", "{{ x | nope }}", "{% import os %}", "{{ }}", "{% endif %}", "{{ 'a }}", "{{ x ** 2 }}", "{% if x %}{% else y %}{% endif %}", "{% if x %}{% endif y %}", "{{ x.format('a') }}", "{{ x is odd_one }}", "{# a", "{{ x[] }}", "{{ x.__class__() }}", "{{ 1 + 'a' }}"])
def test_errors(source):
    with pytest.raises(ct.TemplateError):
        ct.compile_template(source)


def test_loops_only_over_lists():
    with pytest.raises(ct.TemplateError):
        rendered("{% for c in x %}{{ c }}{% endfor %}", x="abc")


def test_escapes_are_reversible():
    rnd = random.Random(1)
    controls = ["<|x|>", "</s>", "aba", "[I]"]
    escape, unescape = ct.escaper(controls), ct.unescaper()
    for _ in range(3000):
        text = "".join(rnd.choices(["<", "|", "x", ">", "</s>", "aba", "a", "b", "\\", "[I]", "\n"], k=rnd.randint(0, 12)))
        safe = escape(text)
        assert unescape(safe) == text and not any(c in safe for c in controls)


def expected(rows):
    out, by = [], {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(t[5] for t in turns if t[3] == "assistant")
        digest = hashlib.sha256("".join(f"{t[3]}\n{t[5]}\n" for t in turns).encode()).hexdigest()
        out.append((c, len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [7, 1 << 20])
def test_conversations(spark, monkeypatch, part):
    rnd = random.Random(part)
    bits = ["hello ", "é日🙂", *cf.CONTROLS, "\\", "\n", "<", "|", "</", "s>", ""]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "</s>\n", None]), "".join(rnd.choices(bits, k=rnd.randint(0, 9)))) for c in range(40) for t in range(rnd.randint(1, 9))]
    rows += [(3, 0, "assistant", "again"), (3, 0, "assistant", "again"), (None, 1, "assistant", None), (None, None, None, "x"), (50, 1, "assistant", "long \\</s>" * 20000)]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]
    rnd.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    function = cf._formatted
    monkeypatch.setattr(cf, "_formatted", lambda *a: with_part(function(*a), part))
    formatted = cf.format_conversations(turns)
    got = cf.read_back(formatted).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)
    sizes = {r.conv_id: r.n for r in formatted.selectExpr("conv_id", "length(text) as n").groupBy("conv_id").agg({"n": "sum"}).toDF("conv_id", "n").collect()}
    assert {r.conv_id: r.formatted_chars for r in got} == sizes
    assert cf.read_back(cf.format_conversations(turns.limit(0))).count() == 0


def with_part(rows, part):
    def run(batches):
        cf.PART = part
        yield from rows(batches)

    return run


def test_pieces_and_spans():
    render = ct.compile_template(cf.TEMPLATE, {"escape": ct.escaper(cf.CONTROLS)})
    pieces = list(render({"messages": [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b</s>"}]}))
    assert "".join(p for p in pieces if isinstance(p, str)) == "<|turn|>user<|text|>a<|end|>\n<|turn|>assistant<|text|>b<\\/s><|end|>\n"
    assert pieces[pieces.index(ct.BEGIN) + 1 : pieces.index(ct.END)] == ["b<\\/s>"]


# Templates in the style of published ones.
MARKED = """{% for message in messages %}
    {%- if loop.first and message['role'] != 'system' %}{{ '<|im_start|>system\nBe brief.<|im_end|>\n' }}{% endif -%}
    {{ '<|im_start|>' + message['role'] + '\n' }}{% if message.role == 'assistant' %}{% generation %}{{ message['content'] | trim + '<|im_end|>' }}{% endgeneration %}{{ '\n' }}{% else %}{{ message['content'] + '<|im_end|>' + '\n' }}{% endif %}
{%- endfor %}
{%- if add_generation_prompt is defined and add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"""
BRACKETED = """{%- if messages[0]['role'] == 'system' -%}
    {%- set system = messages[0]['content'] -%}{%- set rest = messages[1:] -%}
{%- else -%}
    {%- set system = none -%}{%- set rest = messages -%}
{%- endif -%}
{%- for m in rest -%}
    {%- if (m.role == 'user') != (loop.index0 % 2 == 0) -%}{{ raise_exception('Roles must alternate') }}{%- endif -%}
    {%- set content = '<<SYS>>\n' ~ system ~ '\n<</SYS>>\n\n' ~ m.content if loop.index0 == 0 and system is not none else m.content -%}
    {%- if m.role == 'user' -%}{{ '<s>' + '[INST] ' + content.strip() + ' [/INST]' }}{%- else -%}{% generation %}{{ ' ' + content.strip() + ' ' + '</s>' }}{% endgeneration %}{%- endif -%}
{%- endfor -%}"""
HEADED = """{% set ns = namespace(turns=0) %}
{% for m in messages %}
    {% set ns.turns = ns.turns + 1 %}
    {% set head = '<|start|>' ~ m['role'] ~ '<|end|>\n\n' %}
    {% if m.role not in ['assistant', 'tool'] %}
{{ head ~ (m.content | trim) ~ '<|eot|>' }}
    {% else %}
{{ head }}{% generation %}{{ (m.content | trim) ~ '<|eot|>' }}{% endgeneration %}

    {% endif %}
{% endfor %}
{{ ns.turns }}"""


def test_published_styles():
    turns = [{"role": "user", "content": " hi "}, {"role": "assistant", "content": "ho "}]
    assert rendered(MARKED, messages=turns, add_generation_prompt=True) == (
        "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\n hi <|im_end|>\n<|im_start|>assistant\n<<ho<|im_end|>>>\n<|im_start|>assistant\n"
    )
    system = [{"role": "system", "content": "S"}]
    assert rendered(BRACKETED, messages=system + turns) == "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\n hi [/INST]<< ho </s>>>"
    assert rendered(BRACKETED, messages=turns) == "<s>[INST] hi [/INST]<< ho </s>>>"
    with pytest.raises(ct.TemplateError, match="alternate"):
        rendered(BRACKETED, messages=turns[1:])
    got = "".join({ct.BEGIN: "<<", ct.END: ">>"}.get(p, p) for p in ct.compile_template(HEADED, trimmed=True)({"messages": turns}))
    assert got == "<|start|>user<|end|>\n\nhi<|eot|>\n<|start|>assistant<|end|>\n\n<<ho<|eot|>>>\n2"
    assert ct.streams(MARKED, "messages") and not ct.streams(BRACKETED, "messages") and ct.streams(cf.TEMPLATE, "messages")


def test_a_template_that_looks_back_at_messages(spark):
    turns = spark.createDataFrame([(1, 0, "system", "S", 1), (1, 1, "user", "u", 1), (1, 2, "assistant", "a", 1)], "conv_id long, turn long, role string, text string, loss int")
    (r,) = cf.format_conversations(turns, BRACKETED).collect()
    assert r.text == "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\nu [/INST] a </s>" and [r.text[x.start : x.end] for x in r.loss] == [" a </s>"]
