"""Golden rows of FIXTURES.md section 5."""

import pytest
from pyspark.sql import functions as F

from calibspark.functions import code as CODE
from calibspark.functions import meta as MT
from calibspark.functions import outcomes as O
from calibspark.functions import stats as ST
from calibspark.functions import tokens as TK
from calibspark.operators.multiple_testing import bh_adjust
from calibspark.operators.sampling import quota_select


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_meta_parse(spark):
    rows = [("{'source': 'github', 'path': 'a/B.java', 'repo_name': 'r'}",), ("not a dict",), ("{'a': ",),
            ("{'a': None, 'b': True}",)]
    out = one(spark, MT.parse_meta(F.col("m")), rows, "m string")
    assert out[0] == {"source": "github", "path": "a/B.java", "repo_name": "r"}
    assert out[1] is None and out[2] is None
    assert set(out[3]) == {"a", "b"} and out[3]["a"] is None


def test_extension_rule(spark):
    paths = [("a.b/C.JAVA",), ("py",), ("java",), ("m.py",), ("x.java",)]
    ext = one(spark, MT.extension(F.col("p")).isin("java", "py"), paths, "p string")
    lab = one(spark, MT.language_from_path(F.col("p")), paths, "p string")
    assert ext == [False, True, True, True, True]
    assert lab[1:] == ["python", "python", "python", "java"]


@pytest.mark.parametrize("rows,expected", [
    ([(0, "r1", "java"), (1, "r1", "python"), (2, "r2", "java"), (3, "r3", "python")], [0, 3]),
    ([(0, "r1", "java"), (1, "r2", "java"), (2, "r2", "python")], [0, 2]),
])
def test_quota_q1(spark, rows, expected):
    df = spark.createDataFrame(rows, "pos long, repo string, language string")
    got = sorted(r.pos for r in quota_select(df, 1, ["java", "python"]).collect())
    assert got == expected


def test_path_dimensions(spark):
    m, q, lng = O.path_dimensions(F.col("p"))
    r = spark.createDataFrame([("converted-codellama-7b-2bit-mixed/java_benchmark_t",)], "p string") \
        .select(m, q, lng).first()
    assert tuple(r) == ("codellama-7b", "2bit-mixed", "java")


def test_pass_flag(spark):
    rows = [("OK", 0), ("OK", 1), ("Exception", 0), (None, 0)]
    assert one(spark, O.pass_flag(F.col("s"), F.col("e")), rows, "s string, e int") == [1, 0, 0, 0]


def test_pass_at_k(spark):
    rows = [(20, 0, 1), (20, 5, 1), (20, 5, 10), (20, 20, 1)]
    df = spark.createDataFrame(rows, "n int, c int, k int")
    got = [df.where(F.col("k") == k).select(ST.pass_at_k(F.col("n"), F.col("c"), k)).collect() for k in (1, 10)]
    vals = [r[0] for r in got[0]] + [r[0] for r in got[1]]
    assert vals == pytest.approx([0.0, 0.25, 1.0, 0.983746], abs=1e-6)


def test_exact_p(spark):
    rows = [(0, 0), (0, 5), (3, 7), (10, 10), (120, 180)]
    got = one(spark, ST.mcnemar_exact_p(F.col("b"), F.col("c")), rows, "b long, c long")
    assert got == pytest.approx([1.0, 0.0625, 0.34375, 1.0, 0.000634220], rel=1e-5)


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.04]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    got = [r.p_adj for r in bh_adjust(df, family=[], tiebreak=["i"]).orderBy("i").collect()]
    assert got == pytest.approx([0.025, 0.04, 0.04, 0.025, 0.04])


def test_id_trimming(spark):
    rows = [([0, 0, 1, 5, 6, 2, 7],), ([0, 0],), ([5, 6],)]
    got = one(spark, TK.trim_generated(F.col("ids"), 0, 1, [0, 1, 2]), rows, "ids array<int>")
    assert got == [[5, 6], [], [5, 6]]


def test_safe_name(spark):
    assert one(spark, O.safe_name(F.col("n")), [("org/model-7b",)], "n string") == ["org_model_7b"]


Q = '"' * 3


def cut(spark, cases, language):
    return one(spark, CODE.cut_first_function(F.col("p"), F.col("c"), F.lit(language)), cases, "p string, c string")


def test_cut_python(spark):
    cases = [("def f():\n", "    return 1\n\nprint(f())\n", "    return 1"), ("x = 1\n", "y = 2\n", "y = 2\n"),
             ("def f():\n    return 1\n\n", "x = 2\n", ""), ("x = 3\n", "def g():\n    pass\n\nz = 1\n", "def g():\n    pass"),
             ("def f(\n    x\n):\n", "    return x\n\nprint(1)", "    return x"),
             ('def f():\n    """doc\nat margin\n    """\n', "    return 2\ny = 1", "    return 2"),
             ("def f():\n", "    a = 1\n# note\n    return a\n# tail\nx = 1", "    a = 1\n# note\n    return a"),
             ("def f():\n", "    s = " + Q + "\nx\n" + Q + "\n    t = \\\n1\n    return '#(['\nz", "    s = " + Q + "\nx\n" + Q + "\n    t = \\\n1\n    return '#(['"),
             ("def f():\n", "    return (1,\n2", "    return (1,\n2")]
    assert cut(spark, [c[:2] for c in cases], "python") == [c[2] for c in cases]


def test_cut_java(spark):
    cases = [("class A { static int f() {\n", "return 1; }\nstatic void g() {} }", "return 1; }"),
             ("class A {\n", "int x;\n}", "int x;\n}"),
             ("class A { A(int x) { y(); }\n public <T> List<T> f(Map<K, V> m) throws E {", "if (a) { b('}', \"}\"); /* } */ }\n}}", "if (a) { b('}', \"}\"); /* } */ }\n}"),
             ("class A { int f() {", "while (true) { x();", "while (true) { x();")]
    assert cut(spark, [c[:2] for c in cases], "java") == [c[2] for c in cases]


def test_comments_and_doc_split(spark):
    code = [("x = 1  # c\ny = 2",), ('def f():\n    """doc\n  x"""\n    s = """keep\n"""  # gone\n    t = "# no"\n',)]
    assert one(spark, CODE.strip_comments(F.col("c"), F.lit("python")), code, "c string") == [
        "x = 1  \ny = 2", 'def f():\n    \n\n    s = """keep\n"""  \n    t = "# no"']
    rows = [("// d\nint f(){}",), ("int f(){}",), ("\n/* a\n*/ // b\n\nint g(){}\n",)]
    assert [tuple(r) for r in one(spark, CODE.split_doc(F.col("c"), F.lit("java")), rows, "c string")] == [
        ("// d\n", "int f(){}\n"), ("", "int f(){}"), ("/* a\n*/ // b\n\n", "int g(){}\n")]


def test_meta_literals(spark):
    rows = [("{'a': 'x, None, y'}",), ("{'a': ('b','c')}",), ("{'a': 1,}",), ("{'a': None, 'b': True, \"c\": \"it's\", 'd': 'say \"hi\"', 'e': 'it\\'s'}",),
            ("{}",), ("{'l': [1, (2, 3,), {'k': False}]}",)]
    assert one(spark, MT.parse_meta(F.col("m")), rows, "m string") == [
        {"a": "x, None, y"}, {"a": '["b","c"]'}, {"a": "1"}, {"a": None, "b": "true", "c": "it's", "d": 'say "hi"', "e": "it's"},
        {}, {"l": '[1,[2,3],{"k":false}]'}]


def test_fixture_known_counts(spark):
    from calibspark.sources import fixtures as FX
    from tests.conftest import SF_MID
    a = FX.attempts_with_pass(spark, SF_MID)
    assert a.count() == 192000
    assert a.where("status = 'OK'").count() == 61543
    assert a.where("pass = 1").count() == 60202


def test_keep_until(spark):
    from calibspark.functions.text import keep_until
    rows = [("a\nbcd\nefg\n", 1, 2), ("abc", 0, 1), ("x\ny", 1, 5)]
    got = one(spark, keep_until(F.col("c"), F.col("l"), F.col("k")), rows, "c string, l int, k int")
    assert got == ["a\nbc", "a", "x\ny"]


def test_run_labels(spark):
    rows = [("org/codellama-7b", "java", "0.2"), ("deepseekcoder-7b", "py", "0.8")]
    df = spark.createDataFrame(rows, "hub string, lang string, t string")
    label = O.model_label(F.col("hub"))
    out = df.select(label.alias("label"), O.safe_name(F.col("hub")).alias("safe"),
                    O.safe_name(F.col("hub"), F.lit("")).alias("safe_empty_override"),
                    O.run_dir_label(F.col("lang"), F.col("t"), label).alias("run"),
                    O.cleaned_path(F.concat_ws("/", F.lit("out"), O.safe_name(F.col("hub")),
                                               O.run_dir_label(F.col("lang"), F.col("t"), label))).alias("clean"),
                    O.pass_report_name(label, F.col("lang"), F.col("t")).alias("report")).collect()
    assert tuple(out[0]) == ("codellama-7b", "org_codellama_7b", "org_codellama_7b",
                             "java_benchmark_temperature_0.2_codellama-7b",
                             "out/org_codellama_7b/java_benchmark_temperature_0.2_codellama-7b_cleaned",
                             "pass_result_temp_0_2_java_codellama-7b.csv")
    assert out[1].label == "deepseekcoder-7b" and out[1].report == "pass_result_temp_0_8_py_deepseekcoder-7b.csv"


def test_cut_equals_the_indentation_rule_on_random_plain_code(spark):
    """Code without strings or brackets: the plain line rule holds."""
    import random
    import re
    rnd = random.Random(7)
    stmts = ["x = 1", "y = x + 2", "return y", "pass", "z = y * 3"]
    cases = []
    for _ in range(60):
        lines, depth = [], 0
        for _ in range(rnd.randint(1, 12)):
            kind = rnd.random()
            if kind < 0.25:
                lines.append("    " * depth + f"def f{rnd.randint(0, 9)}:")
                depth = min(depth + 1, 3)
            elif kind < 0.35:
                lines.append("")
            else:
                depth = rnd.randint(0, depth)
                lines.append("    " * depth + rnd.choice(stmts))
        code = "\n".join(lines) + rnd.choice(["", "\n", "\n\n"])
        at = rnd.randint(0, len(code))
        cases.append((code[:at], code[at:]))
    def rule(prompt, completion):
        lines = (prompt + completion).split("\n")
        ind = [len(x) - len(x.lstrip()) for x in lines]
        first = next((k for k, x in enumerate(lines) if re.match(r"\s*def\s+\w+", x)), None)
        if first is None:
            return completion
        end = next((k for k in range(first + 1, len(lines)) if lines[k].strip() and ind[k] <= ind[first]), len(lines))
        return "\n".join(lines[:end]).rstrip()[len(prompt):]
    assert cut(spark, cases, "python") == [rule(*c) for c in cases]
