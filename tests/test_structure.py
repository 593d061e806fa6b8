"""Parsing, sniffing, grading and the operators behind them, on made-up inputs."""

import io
import json
import random
import zipfile

import pytest

from lodestrata.functions import parse
from lodestrata.operators import corpus, noise, render, structure
from lodestrata.sources.corpus import sniff_content


@pytest.mark.parametrize(
    ("fmt", "text", "tier", "strict"),
    [
        ("json", '[{"a": 1}, {"a": 2}]', "tier1", 1),
        ("json", '[{"a": 1}, {"a": 2},]', "tier2", None),
        ("json", '{"a": 1}', "tier2", 0),
        ("json", "[]", "tier3", 0),
        ("json", '{"a": 1}\n{"a": 2}\n', "tier1", 1),
        ("json", '{\n"a": 1},\n{"a": 2}', "tier2", 0),
        ("json", "{a: 'x', /* c */ b: [1,],}", "tier2", 0),
        ("json", "nothing", "tier3", 0),
        ("jsonl", '{"a":1}\n{"a":2}\nbad\n{"a":3}\n', "tier2", 0.75),
        ("csv", "a,b\n1,2\n3,4\n", "tier1", 1),
        ("csv", "a,b\n1,2,\n3,4\n", "tier1", 1),
        ("csv", 'a,b\n"x,y",2\n3\n', "tier2", None),
        ("tsv", "a\tb\n1\t2\n", "tier1", 1),
        ("sql", "CREATE TABLE t (a INT);\nINSERT INTO t VALUES (';');\n", "tier1", 1),
        ("sql", "INSERT INTO t VALUES (1);\nINSERT INTO t VALUES ('x", "tier2", 0.5),
        ("sql", "SELECT 1;", "tier3", 0),
        ("log", "x", "noise", None),
        ("free_text", "x", "free_text", None),
        ("other", "x", "tier3", 0),
    ],
)
def test_grade(fmt, text, tier, strict):
    g = parse.grade(fmt, text.encode(), "utf-8")
    assert g["tier"] == tier
    if strict is not None:
        assert g["I_strict"] == pytest.approx(strict)
    if g["I_strict"] is not None:
        assert (g["tier"] == "tier1") == (g["I_strict"] == 1)


def test_csv_header_mismatch():
    g = parse.grade("csv", b'"id,name,phone"\n' + b"1,a,b\n" * 5, "utf-8")
    assert g["n_form"] == "header_col_mismatch"


@pytest.mark.parametrize("text", ["a'';b", "x;y", "$$ ; $$", "a /* ; */", "b -- ;\n"])
def test_sql_split_hides(text):
    quoted = f"'{text}'" if ";" in text and text[0] in "ax" and "*" not in text else text
    assert len(parse.split_sql(f"SELECT {quoted};SELECT 2;")) == 2


def test_sql_rows():
    rows = parse.sql_tables("CREATE TABLE public.u (a INT, b DECIMAL(1,2), PRIMARY KEY (a));\nINSERT INTO public.u VALUES (1, 'it''s'), (2, NULL);INSERT INTO v VALUES (1, NOW(), 'x');")
    assert rows == {"public.u": [{"a": "1", "b": "it's"}, {"a": "2", "b": None}], "v": [{"col_0": "1", "col_1": "NOW()", "col_2": "x"}]}


def test_dialects():
    assert parse.sql_dialect("CREATE TABLE `t` (a INT AUTO_INCREMENT) ENGINE=InnoDB") == ("mysql", "confident")
    assert parse.sql_dialect("select 1") == ("ansi", "unknown")
    assert parse.sql_dialect("PRAGMA x; a INT AUTO_INCREMENT")[1] == "ambiguous"
    assert parse.sql_dialect("SELECT x::text")[1] == "weak"


def test_encodings():
    for enc in ("utf-8", "gb18030", "utf-16", "utf-8-sig"):
        raw = '[{"姓名": "张三丰和李四光"}]'.encode(enc)
        assert parse.grade("json", raw, parse.encoding_of(raw))["tier"] == "tier1"
    assert parse.is_binary(bytes(range(32)) * 20) and not parse.is_binary("文字".encode())


@pytest.mark.parametrize(
    ("text", "fmt"),
    [
        ('{\n"a": [1, 2]\n}', "json"),
        ('{"a": 1}\n{"a": 2}', "jsonl"),
        ("a\tb\n1\t2\n3\t4", "tsv"),
        ("a,b\n1,2\n3,4", "csv"),
        ("CREATE TABLE t (a INT);\nINSERT INTO t VALUES (1);", "sql"),
        ("2024-01-01 10:00:00 INFO start\n2024-01-01 10:00:01 ERROR stop", "log"),
        ("This is a long sentence that goes on and on without any structure.\nAnd another one of the same kind follows here.", "free_text"),
        ("x", "free_text"),
    ],
)
def test_sniff(text, fmt):
    assert sniff_content(text.encode())[0] == fmt


def workbook(rows):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def test_xlsx():
    raw = workbook([["id", "name"], [1, "a"], [2.5, "b"]])
    assert parse.grade("xlsx", raw, None)["tier"] == "tier1"
    assert parse.file_records("xlsx", raw, None) == [("sheet:S", {"id": 1, "name": "a"}), ("sheet:S", {"id": 2.5, "name": "b"})]
    assert parse.grade("xlsx", b"no", None)["tier"] == "tier3"


def test_leaves_and_signature():
    rec = {"b": [{"x": 1}, {"y": None}], "a": {"c": True}, "e": [], "t": ["u", 2]}
    assert list(parse.leaves(rec)) == [("b[].x", 1), ("b[].y", None), ("a.c", True), ("t[]", "u"), ("t[]", 2)]
    assert parse.signature(rec) == '{"a":{"c":<bool>},"b":[{"x":<int>}],"e":[],"t":[<str>]}'
    assert parse.leaf_types(rec) == {"b[].x": {"num"}, "a.c": {"bool"}, "t[]": {"str", "num"}}


def test_clusters_over_distinct_shapes():
    """Walking distinct shapes gives what walking all records does, for one type a path."""
    rng = random.Random(1)
    for _ in range(300):
        recs = [{p: {rng.choice(["num", "str"])} for p in rng.sample("abcd", rng.randint(1, 3))} for _ in range(rng.randint(1, 25))]
        keys = [json.dumps(sorted((p, sorted(t)) for p, t in r.items())) for r in recs]
        first = dict(zip(reversed(keys), reversed(recs), strict=True))
        distinct = list(dict.fromkeys(keys))
        brief = dict(zip(distinct, parse.cluster_shapes([first[k] for k in distinct]), strict=True))
        assert parse.cluster_shapes(recs) == [brief[k] for k in keys]


def test_union_clusters_falls_back(spark):
    from lodestrata.operators.structure import signatures, union_clusters

    recs = [(0, 1, '{"a": 1}'), (0, 2, '{"a": "x"}'), (0, 3, '{"b": 1}'), (1, 1, '{"a": [1, "x"]}'), (1, 2, '{"a": [2]}')]
    got = union_clusters(signatures(spark.createDataFrame(recs, "unit long, seq long, rec string"), ["unit", "seq"]), ["unit"], "seq").collect()
    assert sorted((r.unit, r.first, r.cluster) for r in got) == [(0, 1, 0), (0, 2, 1), (0, 3, 0), (1, 1, 0), (1, 2, 0)]


def test_patterns_and_masks(spark):
    from pyspark.sql import functions as F

    from lodestrata.functions import chars

    rows = [("AB12-张三", "L{2}D{2}PC{2}"), ("", ""), ("a b", "L_L"), ("é1", "LD"), ("Привет!", "X{6}P"), ("DLX", "L{3}")]
    df = spark.createDataFrame(rows, "s string, want string").select("want", chars.pattern(F.col("s")).alias("got"), chars.mask(F.col("s")).alias("m"))
    got = df.collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert got[0].m == "****-**"


@pytest.mark.parametrize("fmt", ["json", "jsonl", "csv", "tsv", "sql", "xlsx"])
def test_render_round_trip(fmt):
    skeleton = {"id": "int", "name": "str"} if not fmt.startswith("json") else {"id": "int", "u.name": "str", "o[].x": "float", "o[].y": "bool", "t[]": "str"}
    text = render.render("u1", fmt, skeleton)
    assert text == render.render("u1", fmt, skeleton)
    assert render.recovered_paths(fmt, text) == set(skeleton)
    assert parse.grade(render.surface(fmt), text.encode(), "utf-8")["tier"] == "tier1"


def test_client_gate():
    class Broken:
        def complete(self, prompt):
            return "sorry"

    assert render.render_with(render.OfflineClient(), "u", "jsonl", {"a": "int", "b.c": "str"})[1] == "client"
    assert render.render_with(Broken(), "u", "jsonl", {"a": "int"})[1] == "template"


def test_matrix_parsing():
    text = 'Here:\n```json\n[{"a ": 1, "b": null}, {"a": 2, "b": "x"}, {"a": 3'
    rows = render.parse_matrix(text, ["a", "b"])
    assert rows == [{"a": 1}, {"a": 2, "b": "x"}]
    value = render.fill_with(rows)
    assert [value("a", "int") for _ in range(3)] == [1, 2, 1] and isinstance(value("z", "str"), str)


CSV = "name,age,city\nann,31,oslo\nbob,42,rome\n"


def test_cells_and_labels():
    assert [CSV[a:b] for _, _, a, b in parse.csv_cells(CSV)] == ["name", "age", "city", "ann", "31", "oslo", "bob", "42", "rome"]
    for seed in range(60):
        e = noise.example(CSV, random.Random(seed), size=64)
        assert len({len(e[k]) for k in ("input_ids", "attention", "field", "new_field", "new_record", "damaged")}) == 1
        body = e["input_ids"][1 : 1 + len(e["noised"])]
        assert "".join(map(chr, body)) == e["noised"][: len(body)]
        assert sum(e["damaged"]) == max(0, len(e["noised"]) - len(CSV))
        assert len(e["anchor"]) == len(e["spans"])


def test_csv_fingerprints():
    a = corpus.csv_fingerprint("id,carrier\n1,x\n2,y\n")
    assert a == corpus.csv_fingerprint("ID,Carrier\n7,z\n") and json.loads(a)[0] == "H"
    v = json.loads(corpus.csv_fingerprint('3,a@b.c,,"1,2"\n4,d@e.f,n,"3"\n'))
    assert v == ["V", 4, [["num"], ["str"], ["str"], ["num"]]]


def test_dedup_csv_merges_blank_columns(spark):
    texts = {0: "1,a,\n2,b,\n", 1: "3,c,9\n", 2: "x,y,z\n1,2,3\n", 3: "X, Y,Z\n4,5,6\n", 4: ""}
    df = spark.createDataFrame([(i, corpus.csv_fingerprint(t)) for i, t in texts.items()], "unit_id int, fp string")
    got = {r.unit_id: (r.representative, r.cluster_size) for r in corpus.dedup_csv(df).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 2), 3: (2, 2), 4: (4, 1)}


def test_corpus_end_to_end(spark, tmp_path):
    from lodestrata.plans.cli import main
    from lodestrata.streaming.ingest import stream_grades

    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    (root / "a.json").write_text('[{"id": 1, "phone": "1"}, {"id": 2}]')
    (root / "b.csv").write_text("id,name\n1,x\n2,y\n")
    (root / "deep/c.txt").write_text('{"id": 1, "phone": "2"}\n{"id": 3, "phone": "4"}\n')
    (root / "bad.jsonl").write_text('{"id": 1}\noops\n')
    (root / "empty.json").write_text("")
    (root / "book.xlsx").write_bytes(workbook([["k"], ["v"]]))
    for _ in range(2):  # the second run finds all files graded
        main(["pipeline", str(root), "-o", str(tmp_path / "out")])
    graded = {r.path.rsplit("/", 1)[1]: r.tier for r in spark.read.parquet(f"{tmp_path}/out/grades").collect()}
    assert graded == {"a.json": "tier1", "b.csv": "tier1", "c.txt": "tier1", "bad.jsonl": "tier2", "book.xlsx": "tier1"}
    units = spark.read.parquet(f"{tmp_path}/out/units")
    assert sorted(r.cluster_size for r in units.collect()) == [1, 1, 2] or units.count() == 4
    view = spark.read.parquet(f"{tmp_path}/out/global_view").first()
    assert view.units == 4 and view.records == 7
    q = stream_grades(spark, str(root), f"{tmp_path}/stream", f"{tmp_path}/check")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/stream").count() == 5


def test_rest_works_without_llm():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['lodestrata.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    hide = "import importlib.abc, sys\nclass H(importlib.abc.MetaPathFinder):\n  def find_spec(s, n, p=None, t=None):\n    if n.startswith('lodestrata.llm') or n == 'corpus_pipeline': raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, H())\n"
    subprocess.run([sys.executable, "-c", hide + code.split("; ", 2)[0] + "; " + code.split("; ", 2)[2]], check=True, cwd=Path(__file__).resolve().parents[1])


def test_log_levels_in_any_case_and_first_fitting_delimiter():
    from lodestrata.sources.corpus import vote_format

    for level in ("info", "INFO", "Warn"):
        rows = [f"2024-01-01 10:00:0{k} {level} job, step {k}, done" for k in range(8)]
        score = vote_format(rows, "\n".join(rows))
        assert max(score, key=score.get) == "log"
    rows = ["a\tb,c"] * 8 + ["a,b c"]  # a tab in most lines, a comma in all
    score = vote_format(rows, "\n".join(rows))
    assert score["tsv"] > 0 and score["csv"] == 0


def moved_workbook(target, cell):
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", parse.OFFICE
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="S" sheetId="7" r:id="rId3"/><sheet name="gone" sheetId="8" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId3" Target="{target}"/><Relationship Id="rId9" Target="worksheets/none.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet4.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="inlineStr"><is><t>id</t></is></c></row><row><c r="A2"><v>{cell}</v></c></row></sheetData></worksheet>')
    return out.getvalue()


@pytest.mark.parametrize("target", ["worksheets/sheet4.xml", "/xl/worksheets/sheet4.xml"])
def test_workbook_whose_sheet_lies_elsewhere(target):
    raw = moved_workbook(target, "1E5")
    assert parse.file_records("xlsx", raw, None) == [("sheet:S", {"id": 1e5})]
    assert parse.grade("xlsx", raw, None)["tier"] == "tier1"


def test_deep_nesting_is_not_json():
    deep = "[" * 3000 + "]" * 3000
    assert parse.json_line(deep) is None and parse.json_line('{"a": "' + "[" * 3000 + '"}') == {"a": "[" * 3000}
    for fmt in ("json", "jsonl"):
        assert parse.grade(fmt, f'{{"a": {deep}}}\n{{"b": 1}}\n'.encode(), "utf-8")["tier"] != "tier1"
        parse.file_records(fmt, f"[{deep}, 1]".encode(), "utf-8")


def test_concatenated_values_have_no_limit():
    text = '{"a": 1}' * 5000
    assert parse.grade("json", text.encode(), "utf-8")["n_unit"] == 5000 == len(parse.file_records("json", text.encode(), "utf-8"))
    assert len(parse.file_records("json", text.encode(), "utf-8", most=10)) == 10
    lines = '{"a": 1}\n' * 30
    assert len(parse.file_records("jsonl", lines.encode(), "utf-8", most=7)) == 7


def test_occurrence_is_over_all_records(spark):
    rows = [("u", k, r) for k, r in enumerate(['{"a": 1}', "{}", "{}", '{"b": null}', '{"c": "x"}', '{"c": 1}'])]
    recs = spark.createDataFrame(rows, "unit string, rec_seq long, rec string")
    got = {r.field_path: r for r in structure.field_types(structure.leaves(recs, ["unit", "rec_seq"]), ["unit"], "rec_seq", recs).collect()}
    assert got["a"].occurrence == round(1 / 6, 4) and (got["b"].type, got["b"].occurrence, got["b"].types) == ("null", 0.0, [])
    assert (got["c"].type, got["c"].dominant_ratio) == ("str", 0.5)  # the first seen of a tie


def test_vocabulary_closes_over_types_and_bands(spark):
    pii = lambda t: ("high_conf", t) if t else None
    rows = [("u1", "phone", pii("phone_number"), "str:4"), ("u2", "x", None, "str:4"), ("u3", "mail", pii("email"), "str:4"), ("u1", "mail2", pii("email"), "str:5"), ("u2", "y", None, "str:5"), ("u1", "alone", None, "str:9"), ("u1", "alone2", None, "str:9"), ("u3", "mail3", pii("email"), None)]
    fields = spark.createDataFrame(rows, "unit string, key_name string, pii struct<level:string,type:string>, band string")
    vocab = corpus.vocabulary(fields, "unit", evidence_b=True)
    got = {}
    for r in vocab.collect():
        got.setdefault(r.semantic_class, set()).add(r.key_name)
    assert got == {"<EMAIL>": {"phone", "x", "mail", "mail2", "y", "mail3"}, "alone": {"alone"}, "alone2": {"alone2"}}
    assert [r.semantic_class for r in corpus.uncertain(vocab).collect()] == ["<EMAIL>"]
    plain = {(r.semantic_class, r.key_name) for r in corpus.vocabulary(fields, "unit").collect()}
    assert ("<PHONE_NUMBER>", "phone") in plain and ("x", "x") in plain


def test_fill_keeps_structure_whatever_the_answer():
    from lodestrata.operators import fill

    class Silent:
        def complete(self, prompt):
            return "no"

    skeleton = {"e mail": "str", "n": "int", "u.city": "str"}
    full = fill.fill(fill.OfflineValues(), "u1", "json", skeleton)
    assert (full["n_filled"], full["n_missing"], full["answer"]) == (3, 0, None) and "@example.org" in full["text"]
    assert full == fill.fill(fill.OfflineValues(), "u1", "json", skeleton)
    less = fill.fill(fill.OfflineValues(2), "u1", "json", skeleton)
    assert less["missing"] == ["n", "u.city"]
    none = fill.fill(Silent(), "u1", "json", skeleton)
    assert (none["n_filled"], none["answer"]) == (0, "no")
    for got in (full, less, none):
        assert render.recovered_paths("json", got["text"]) == set(skeleton)


def test_value_prompt_examples():
    from lodestrata.operators import fill

    samples = {"a": [None, "NULL", "***1", "x" * 60 + "…"]}
    assert json.dumps(["a", "str", "x" * 48]) in fill.value_prompt({"a": "str"}, 3, samples)
    wide = {f"c{k}": "str" for k in range(401)} | {"a": "str"}
    assert "xxx" not in fill.value_prompt(wide, 3, samples)
    assert render.value_rows(401, 3) == 1 and render.value_rows(2, 3) == 3


def test_jsonl_appends_and_skips_cut_lines(spark, tmp_path):
    from lodestrata.sources.jsonl import append_jsonl, read_jsonl

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    append_jsonl(rows, f"{tmp_path}/log")
    append_jsonl(rows, f"{tmp_path}/log")
    (tmp_path / "log" / "cut.txt").write_text('{"id": 3, "v": "b"}\n\n{"id": 4, "v')
    got = sorted(r.value.replace(" ", "") for r in read_jsonl(spark, f"{tmp_path}/log").collect())
    assert got == ['{"id":1,"v":"a"}'] * 2 + ['{"id":2,"v":null}'] * 2 + ['{"id":3,"v":"b"}']


def test_noisy_lines(spark):
    from lodestrata.functions.lines import noisy

    docs = {"steady": ["a,b", "1,2", "3,4"], "one": ["a,b"], "narrow": ["a", "1", "2"], "wild": ["a,b", "1,2,3", "", "1"], "blank": ["", " "]}
    df = spark.createDataFrame([(d, k, x) for d, xs in docs.items() for k, x in enumerate(xs)], "doc string, line_no int, line string")
    assert {r.doc: r.noisy for r in noisy(df, "doc", "line").collect()} == {"steady": False, "one": False, "narrow": True, "wild": True, "blank": False}


def test_csv_files_merge_by_fingerprint(spark):
    # a.csv and b.csv have no header: their first rows name no paths
    texts = {"a.csv": "1,ann\n2,bob\n3,cy\n", "b.csv": "7,dee\n8,eve\n", "c.tsv": "id\tname\n1\tx\n", "d.csv": "ID,Name\n4,y\n", "e.json": '[{"id": 1, "name": "x"}]', "f.json": '[{"id": 2, "name": "y"}]'}
    files = spark.createDataFrame([(p, p.split(".")[1], "utf-8", bytearray(t.encode())) for p, t in texts.items()], "path string, fmt string, encoding string, content binary")
    prints = corpus.file_fingerprints(files).withColumnRenamed("path", "unit_id")
    units = spark.createDataFrame([(p, p.split(".")[1], {"id": "int", "name": "str"} if p.endswith("json") else {p: "str"}) for p in texts], "unit_id string, fmt string, skeleton map<string,string>")
    got = {r.unit_id: (r.representative, r.cluster_size) for r in corpus.dedup_units(units, prints).collect()}
    assert got == {"a.csv": ("a.csv", 2), "b.csv": ("a.csv", 2), "c.tsv": ("c.tsv", 2), "d.csv": ("c.tsv", 2), "e.json": ("e.json", 2), "f.json": ("e.json", 2)}


def test_sniffing_looks_at_whole_brackets_and_whole_lines():
    rows = [json.dumps({"id": k, "name": f"c{k:09}"}) for k in range(3000)]
    assert sniff_content(("[\n" + ",\n".join(rows) + "\n]").encode()) == ("json", "utf-8", 0.9)
    wide = json.dumps({"text": "x" * 100_000})
    assert sniff_content(f"{wide}\n{wide}\n".encode())[0] == "jsonl"


def test_head_lines_are_those_of_the_whole_text(monkeypatch):
    from lodestrata.functions import fixed
    from lodestrata.sources.corpus import head_lines

    rng = random.Random(3)
    for size in (1, 2, 7, 30):
        monkeypatch.setattr(fixed, "HEAD_BYTES", size)
        for _ in range(200):
            text = "".join(rng.choices(["a", "bc ", " ", "\n", "\r\n", "\r", "\u2028"], k=rng.randint(0, 40)))
            assert head_lines(text, 5) == [x.strip() for x in text.splitlines() if x.strip()][:5]


def test_relaxed_json_of_many_comments():
    rows = [{"id": k, "name": f"c{k}"} for k in range(20_000)]
    text = "[ " + ", /* next */ ".join(f"{{id: {r['id']}, name: '{r['name']}', }}" for r in rows) + ",]"
    assert parse.relaxed_json(text) == rows
    assert parse.relaxed_json("[1, /* a */ 2 /* b */ ]") == [1, 2]  # the first comma is not trailing
    assert parse.relaxed_json("[1, // a\n /* b */ ]") == [1]
    for damaged in ("[1, /* a" * 20_000, "[" + '\\"' * 20_000, "['a]", '["a]'):
        with pytest.raises(ValueError):
            parse.relaxed_json(damaged)
