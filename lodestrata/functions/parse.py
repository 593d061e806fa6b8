"""Tokenisers that no built-in expression can stand in for; plain Python over one text each."""

from __future__ import annotations

import csv
import io
import json
import re
import statistics
import unicodedata
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Iterator

from lodestrata.functions.fixed import DIALECTS

BOMS = [(b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")]
HEAD = 64 << 10
#: Values nested deeper than this aren't read as JSON.
DEPTH = 500


def is_binary(raw: bytes) -> bool:
    head = raw[:1024]
    if not head or any(head.startswith(b) for b, _ in BOMS):
        return False
    control = sum(b < 32 and b not in (9, 10, 12, 13) for b in head)
    return head.count(0) > max(len(head) / 256, 1) or control / len(head) > 0.3


def encoding_of(raw: bytes) -> str:
    """BOM, then strict UTF-8, then GB18030, then Latin-1."""
    for bom, name in BOMS:
        if raw.startswith(bom):
            return name
    head = raw[:HEAD]
    for name in ("utf-8", "gb18030"):
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError as e:
            if len(raw) > HEAD and e.start > len(head) - 4:
                return name
    return "latin-1"


def decode(raw: bytes, encoding: str | None = None) -> str:
    return raw.decode(encoding or encoding_of(raw), "replace")


_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)


def shallow(text: str) -> bool:
    """Whether brackets outside strings are nested DEPTH deep at most."""
    if text.count("[") + text.count("{") <= DEPTH:
        return True
    depth = 0
    for m in _BRACKET.finditer(text):
        depth += (m[0] in "[{") - (m[0] in "]}")
        if depth > DEPTH:
            return False
    return True


def json_line(line: str):
    """Parsed value, None if it isn't JSON or nested too deep."""
    try:
        return json.loads(line) if shallow(line) else None
    except (ValueError, RecursionError):
        return None


def json_message(text: str) -> str | None:
    """What the reader says of text that isn't JSON."""
    try:
        json.loads(text)
    except ValueError as e:
        return str(e)
    except RecursionError:
        return "nested too deep"
    return None


#: What stands between a trailing comma and its bracket is taken once, never another way, so no comma looks further than that.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|\'(?:[^\'\\]|\\.)*+\'|//[^\n]*|/\*(?>.*?\*/)|,(?=(?>(?:\s+|//[^\n]*|/\*.*?\*/)*)[}\]])|(?<=[{,\s])[A-Za-z_$][\w$]*+(?=\s*+:)|["\']|/\*', re.S)


def relaxed_json(text: str):
    """JSON with comments, single quotes, trailing commas and bare keys; ValueError if it isn't that either."""

    def fix(m: re.Match) -> str:
        t = m[0]
        if t in ('"', "'", "/*"):
            raise ValueError(f"no end of {t} at {m.start()}")
        if t[0] == '"':
            return t
        if t[0] == "'":
            return json.dumps(t[1:-1].replace("\\'", "'"))
        return "" if t[0] in "/," else json.dumps(t)

    if not shallow(text):
        raise ValueError("nested too deep")
    return json.loads(_TOKEN.sub(fix, text))


_BETWEEN = re.compile(r"[\s,\[\]]*")


def concatenated_values(text: str) -> list:
    """Values that follow one another, whatever brackets and commas stand between; stops at the first that doesn't parse."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while (at := _BETWEEN.match(text, at).end()) < len(text):
        start = at
        try:
            value, at = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            break
        if not shallow(text[start:at]):
            break
        out.append(value)
    return out


def array_prefix(text: str) -> tuple[list, bool]:
    """Items of a top-level array, and whether the array ends as it should."""
    stripped = text.lstrip()
    if not stripped.startswith("["):
        return [], False
    decoder, at, out = json.JSONDecoder(), 1, []
    gap = re.compile(r"\s*")
    while True:
        at = gap.match(stripped, at).end()
        if stripped[at : at + 1] == "]" and not out:
            return out, not stripped[at + 1 :].strip()
        start = at
        try:
            value, at = decoder.raw_decode(stripped, at)
        except (ValueError, RecursionError):
            return out, False
        if not shallow(stripped[start:at]):
            return out, False
        out.append(value)
        at = gap.match(stripped, at).end()
        if stripped[at : at + 1] == "]":
            return out, not stripped[at + 1 :].strip()
        if stripped[at : at + 1] != ",":
            return out, False
        at += 1


def looks_like_jsonl(text: str) -> bool:
    """Two or more of the first five non-blank lines parse, none fails, none is a lone bracket."""
    lines = [x.strip() for x in text.splitlines() if x.strip()][:5]
    if any(x in "[]" for x in lines):
        return False
    good = [json_line(x.rstrip(",")) is not None for x in lines]
    return len(good) >= 2 and all(good)


def json_records(text: str) -> list:
    """Records by the first way that finds any: array, JSON Lines, concatenated values, relaxed whole text."""
    items, _ = array_prefix(text)
    if items:
        return items
    if looks_like_jsonl(text):
        return [v for x in text.splitlines() if x.strip() and (v := json_line(x.strip().rstrip(","))) is not None]
    values = concatenated_values(text)
    if values:
        return [y for x in values for y in (x if isinstance(x, list) else [x])]
    try:
        value = relaxed_json(text)
    except ValueError:
        return []
    return value if isinstance(value, list) else [value]


def sniff_delimiter(text: str, candidates: str = ",;|:\t") -> str:
    """Quote-aware: of those that part the first row, the steadiest over 20 rows."""
    best, spread = ",", None
    for d in candidates:
        rows = [len(r) for r in _rows(text[:HEAD], d, 20)]
        if len(rows) >= 2 and rows[0] >= 2:
            s = statistics.stdev(rows)
            if spread is None or s < spread:
                best, spread = d, s
    return best


def _rows(text: str, delimiter: str, most: int | None = None) -> list[list[str]]:
    out = []
    for row in csv.reader(io.StringIO(text.replace("\0", ""), newline=""), delimiter=delimiter):
        if any(c.strip() for c in row):
            out.append(row)
        if most and len(out) >= most:
            break
    return out


def csv_rows(text: str, delimiter: str | None = None) -> tuple[list[list[str]], str | None]:
    """Non-blank rows, and the reader's error if it died."""
    out = []
    try:
        for row in csv.reader(io.StringIO(text.removeprefix("\ufeff").replace("\0", ""), newline=""), delimiter=delimiter or sniff_delimiter(text)):
            if any(c.strip() for c in row):
                out.append(row)
    except csv.Error as e:
        return out, str(e)
    return out, None


_SQL = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|(\$\w*\$).*?\1|[;()]|['\"`]|/\*|\$\w*\$|[^;()'\"`$/-]+|.", re.S)
SQL_CUT = 1 << 20


def split_sql(text: str, cut: int = SQL_CUT) -> list[tuple[str, bool, bool, bool]]:
    """Statements as (text, terminated, balanced, truncated); quotes, comments and dollar quotes hide semicolons."""
    out, depth, start, open_ = [], 0, 0, False
    for m in _SQL.finditer(text):
        t = m[0]
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif (t in "'\"`" or t == "/*") or (t.startswith("$") and t.endswith("$") and len(t) >= 2 and m[1] is None):
            open_ = True
            break
        elif t == ";" and depth <= 0:
            body = text[start : m.end()].strip()
            if body.strip("; \n\t"):
                out.append((body, True, depth == 0, False))
            start, depth = m.end(), 0
        if m.end() - start > cut:
            out.append((text[start : m.end()], False, False, True))
            start, depth = m.end(), 0
    rest = text[start:].strip()
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", "", rest, flags=re.S).strip()
    if bare:
        out.append((rest, False, depth == 0 and not open_, True))
    return out


def sql_values(body: str) -> list[list]:
    """Tuples after VALUES; strings unquoted, NULL as None, nested calls kept whole."""
    out, row, cell, depth, quoted = [], [], [], 0, False
    for m in re.finditer(r"'(?:[^'\\]|''|\\.)*'|[(),]|[^'(),]+", body, re.S):
        t = m[0]
        if t == "(" and depth == 0:
            row, cell, depth, quoted = [], [], 1, False
        elif depth == 0:
            continue
        elif depth == 1 and t in ",)":
            raw = "".join(cell).strip()
            row.append(raw if quoted else None if raw.upper() == "NULL" else raw)
            cell, quoted = [], False
            if t == ")":
                out.append(row)
                depth = 0
        elif t[0] == "'" and depth == 1:
            cell.append(t[1:-1].replace("''", "'").replace("\\'", "'"))
            quoted = True
        else:
            depth += (t == "(") - (t == ")")
            cell.append(t)
    return out


_CREATE = re.compile(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.`\"\[\]]+)\s*\((.*)\)", re.I | re.S)
_INSERT = re.compile(r"INSERT\s+(?:IGNORE\s+)?INTO\s+([\w.`\"\[\]]+)\s*(?:\(([^)]*)\))?\s*VALUES\s*(.*)", re.I | re.S)
_PLAIN = str.maketrans("", "", "`\"[]")


def sql_tables(text: str) -> dict[str, list[dict]]:
    """Rows of each table that has any, named by the CREATE or INSERT column list, else col_i."""
    columns, rows = {}, {}
    for body, *_ in split_sql(text):
        if m := _CREATE.search(body):
            parts = re.split(r",(?![^(]*\))", m[2])
            names = [p.split()[0].translate(_PLAIN) for p in parts if p.split() and p.split()[0].upper() not in ("PRIMARY", "KEY", "UNIQUE", "CONSTRAINT", "INDEX", "FOREIGN", "CHECK")]
            columns[m[1].translate(_PLAIN)] = names
        elif m := _INSERT.search(body):
            name = m[1].translate(_PLAIN)
            named = [c.strip().translate(_PLAIN) for c in m[2].split(",")] if m[2] else columns.get(name, [])
            for values in sql_values(m[3]):
                keys = named if len(named) == len(values) else [f"col_{i}" for i in range(len(values))]
                rows.setdefault(name, []).append(dict(zip(keys, values, strict=True)))
    return rows


OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def sheet_parts(z: zipfile.ZipFile) -> dict[str, str]:
    """Where a workbook's relations say its sheets lie, by relation id."""
    name = "xl/_rels/workbook.xml.rels"
    if name not in z.namelist():
        return {}
    places = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read(name))}
    return {k: p.lstrip("/") if p.startswith("/") else f"xl/{p}" for k, p in places.items()}


def number(text: str | None):
    """A cell's number, whole if written so; other text as it is."""
    for kind in (int, float):
        try:
            return kind(text or "")
        except ValueError:
            pass
    return text


def xlsx_sheets(raw: bytes) -> dict[str, list[list]]:
    """Cells of each sheet by row; sheets whose part is missing are left out; ValueError if it isn't a workbook."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        book = ET.fromstring(z.read("xl/workbook.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise ValueError(str(e)) from e
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
    out, parts = {}, sheet_parts(z)
    for sheet in book.find("m:sheets", ns) if book.find("m:sheets", ns) is not None else ():
        part = parts.get(sheet.get(f"{{{OFFICE}}}id"), f"xl/worksheets/sheet{len(out) + 1}.xml")
        if part not in z.namelist():
            continue
        rows = []
        for row in ET.fromstring(z.read(part)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, object] = {}
            for c in row:
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                column = 0
                for ch in letters:
                    column = column * 26 + ord(ch) - 64
                v = c.find("m:v", ns)
                inline = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                value = inline if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text if c.get("t") in ("str", "b", "e", "d") else number(v.text)
                cells[column or len(cells) + 1] = value
            rows.append([cells.get(i) for i in range(1, max(cells, default=0) + 1)])
        out[sheet.get("name")] = rows
    return out


def type_tag(v) -> str:
    return "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "str" if isinstance(v, str) else type(v).__name__


def composed(v: str) -> str:
    """A string in normal form C."""
    return v if v.isascii() else unicodedata.normalize("NFC", v)


def norm_type(v) -> str | None:
    tag = type_tag(v)
    return {"null": None, "int": "num", "float": "num", "list": "arr", "dict": "obj"}.get(tag, tag)


def leaves(v, path: str = "") -> Iterator[tuple[str, object]]:
    """(folded path, value) of every leaf: keys joined by dots, array places erased to []."""
    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves(x, f"{path}.{k}" if path else k)
    elif isinstance(v, list):
        for x in v:
            yield from leaves(x, f"{path}[]")
    else:
        yield path, v


def signature(v) -> str:
    """Exact structure: sorted keys, an array's first element, type marks."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{signature(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return f"[{signature(v[0])}]" if v else "[]"
    return f"<{type_tag(v)}>"


def leaf_types(record) -> dict[str, set[str]]:
    """Types seen at each path; nulls and empty containers leave none."""
    out: dict[str, set[str]] = {}
    for path, v in leaves(record):
        if (t := norm_type(v)) is not None:
            out.setdefault(path, set()).add(t)
    return out


def cluster_shapes(shapes: list[dict[str, set[str]]]) -> list[int]:
    """Union-schema clusters in order: a shape joins the first cluster with no shared path of disjoint types, and widens it."""
    protos: list[dict[str, set[str]]] = []
    out = []
    for shape in shapes:
        for k, proto in enumerate(protos):
            if all(not (p in proto) or proto[p] & t for p, t in shape.items()):
                break
        else:
            k, proto = len(protos), {}
            protos.append(proto)
        for p, t in shape.items():
            proto[p] = proto.get(p, set()) | t
        out.append(k)
    return out


def file_records(fmt: str, raw: bytes, encoding: str | None, most: int | None = None) -> list[tuple[str, object]]:
    """(partition, record) of a file by format, the first ``most`` of each partition if that is set.

    Explicit wrapper keys, tables and sheets are partitions of their own.
    """
    taken: Counter = Counter()
    out = []
    for part, record in _every_record(fmt, raw, encoding):
        taken[part] += 1
        if most is None or taken[part] <= most:
            out.append((part, record))
    return out


def _every_record(fmt: str, raw: bytes, encoding: str | None) -> list[tuple[str, object]]:
    if fmt == "xlsx":
        try:
            sheets = xlsx_sheets(raw)
        except ValueError:
            return []
        out = []
        for name, rows in sheets.items():
            rows = [r for r in rows if any(c not in (None, "") for c in r)]
            head = [str(c) if c not in (None, "") else f"col_{j}" for j, c in enumerate(rows[0])] if rows else []
            out += [(f"sheet:{name}", dict(zip(head, [*r, *[None] * (len(head) - len(r))], strict=False))) for r in rows[1:]]
        return out
    text = decode(raw, encoding).removeprefix("\ufeff")
    if fmt in ("csv", "tsv"):
        rows, _ = csv_rows(text, "\t" if fmt == "tsv" else None)
        if not rows or len(set(rows[0])) < 2:
            return []
        return [("csv", dict(zip(rows[0], [*r[: len(rows[0])], *[None] * (len(rows[0]) - len(r))], strict=True))) for r in rows[1:]]
    if fmt == "sql":
        return [(f"table:{t}", r) for t, rs in sql_tables(text).items() for r in rs]
    if fmt == "json":
        whole = json_line(text)
        if isinstance(whole, dict):
            keyed = [(k, r) for k, v in whole.items() if isinstance(v, list) and v and isinstance(v[0], dict) for r in v if isinstance(r, dict)]
            if keyed:
                return [(f"key:{k}", r) for k, r in keyed]
        return [("", r) for r in json_records(text) if isinstance(r, dict)]
    if fmt == "jsonl":
        return [("", v) for x in text.splitlines() if isinstance(v := json_line(x), dict)]
    return []


def _verdict(n_clean, n_fixed, n_lost, n_form=None, n_struct=None, detail=None, error=None) -> dict:
    n = n_clean + n_fixed + n_lost
    if not n:
        return {"tier": "tier3", "I": 0.0, "I_strict": 0.0, "n_form": n_form, "n_struct": n_struct, "detail": detail, "error": error or "nothing recovered", "n_unit": 0, "n_clean": 0}
    strict = n_clean / n
    return {"tier": "tier1" if strict == 1 else "tier2", "I": (n_clean + n_fixed) / n, "I_strict": strict, "n_form": n_form, "n_struct": n_struct, "detail": detail, "error": error, "n_unit": n, "n_clean": n_clean}


def grade(fmt: str, raw: bytes, encoding: str | None) -> dict:
    """Clean, repaired and lost units of a file: tier, I = recovered share, I_strict = clean share."""
    if fmt in ("log", "free_text"):
        return {"tier": "noise" if fmt == "log" else "free_text", "I": None, "I_strict": None, "n_form": None, "n_struct": None, "detail": None, "error": None, "n_unit": 0, "n_clean": 0}
    if fmt == "xlsx":
        try:
            sheets = xlsx_sheets(raw)
        except ValueError as e:
            return _verdict(0, 0, 0, error=str(e))
        return _verdict(len(sheets), 0, 0)
    text = decode(raw, encoding).removeprefix("\ufeff")
    if fmt == "json":
        items, ended = array_prefix(text)
        if items and ended:
            return _verdict(len(items), 0, 0)
        if items:
            used = max(1, sum(len(json.dumps(x, ensure_ascii=False)) for x in items))
            return _verdict(len(items), 0, max(1, round(len(items) * max(0, len(text) - used) / used)), "incomplete")
        if looks_like_jsonl(text):
            return grade("jsonl", text.encode(), "utf-8")
        values = concatenated_values(text)
        values = [y for x in values for y in (x if isinstance(x, list) else [x])]
        if values:
            return _verdict(0, len(values), 0, "concatenated_values")
        try:
            value = relaxed_json(text)
        except ValueError:
            return _verdict(0, 0, 0, "other")
        return _verdict(0, len(value) if isinstance(value, list) else 1, 0, "json5")
    if fmt == "jsonl":
        lines = [(k, x) for k, x in enumerate(text.splitlines(), 1) if x.strip()]
        bad = [{"lineno": k, "len": len(x)} for k, x in lines if json_line(x) is None and x.strip() != "null"]
        return _verdict(len(lines) - len(bad), 0, len(bad), "bad_lines" if bad else None, detail=json.dumps(bad[:5]) if bad else None)
    if fmt in ("csv", "tsv"):
        rows, error = csv_rows(text, "\t" if fmt == "tsv" else None)
        if not rows:
            return _verdict(0, 0, 0)
        widths = [len(r) for r in rows]
        core = [max((i + 1 for i, c in enumerate(r) if c.strip()), default=0) for r in rows]
        modal = Counter(widths).most_common(1)[0][0]
        clean = sum(w == modal or (w > modal and c <= modal) for w, c in zip(widths, core, strict=True))
        kind = "read_interrupted" if error else None if clean == len(rows) else "header_col_mismatch" if widths[0] != modal and clean / len(rows) >= 0.7 else "col_drift"
        cv = statistics.pstdev(widths) / statistics.fmean(widths)
        return _verdict(clean, len(rows) - clean, int(error is not None), kind, cv, json.dumps(Counter(widths)), error)
    if fmt == "sql":
        scope = [s for s in split_sql(text) if re.search(r"CREATE\s+TABLE|INSERT\s+INTO", s[0], re.I)]
        clean = sum(t and b for _, t, b, _ in scope)
        lost = sum(cut for *_, cut in scope)
        kind = "truncated" if lost else "unbalanced" if clean < len(scope) else None
        name, status = sql_dialect(text[:HEAD])
        return _verdict(clean, len(scope) - clean - lost, lost, kind, detail=json.dumps({"dialect": name, "status": status}))
    return _verdict(0, 0, 0, error=f"unknown format {fmt}")


def sql_dialect(text: str) -> tuple[str, str]:
    score = {k: sum(w for p, w in ps if re.search(p, text, re.I | re.M)) for k, ps in DIALECTS.items()}
    (name, top), (_, second) = sorted(score.items(), key=lambda x: -x[1])[:2]
    if not top:
        return "ansi", "unknown"
    return name, "ambiguous" if second and top - second < 2 else "weak" if top < 2 else "confident"


def csv_cells(text: str, delimiter: str = ",", quote: str = '"') -> list[tuple[int, int, int, int]]:
    """(row, column, start, end) of every cell; a quote toggles, a trailing CR isn't part of the cell."""
    out, row, col, start, inside = [], 0, 0, 0, False
    for k, ch in enumerate(text):
        if ch == quote:
            inside = not inside
        elif not inside and ch in (delimiter, "\n"):
            end = k - 1 if ch == "\n" and k > start and text[k - 1] == "\r" else k
            out.append((row, col, start, end))
            start = k + 1
            row, col = (row + 1, 0) if ch == "\n" else (row, col + 1)
    if start < len(text) or col:
        out.append((row, col, start, len(text)))
    return out
