"""Reading meaning out of text: notes, skill files, shell commands, declarations, calls and imports."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..deal import dealt
from ..ship import ship

# What notes say, by kind, in order, and how sure each kind is.
NOTE_PATTERNS = (
    ("decision", 0.7, r"(?i)(?:decided|chose|picked|selected|went with|using|switched to)\s+(\w[\w\s-]{2,30})\s+(?:over|instead of|rather than|because|for|since)"),
    ("decision", 0.7, r"(?i)(?:don't|do not|never|avoid|stop)\s+(?:use|using)\s+(\w[\w\s-]{2,30})"),
    ("decision", 0.7, r"(?i)(?:always|must|should)\s+(?:use|prefer)\s+(\w[\w\s-]{2,30})"),
    ("mistake", 0.6, r"(?i)(?:bug|issue|problem|error|broke|breaking|failed|crash):\s*(.{10,80})"),
    ("mistake", 0.6, r"(?i)(?:fix|fixed|resolved|solved):\s*(.{10,80})"),
    ("mistake", 0.6, r"(?i)(?:caused by|root cause|the issue was)\s+(.{10,80})"),
    ("pattern", 0.65, r"(?i)(?:pattern|convention|approach|technique|strategy):\s*(.{10,80})"),
    ("pattern", 0.65, r"(?i)(?:we use|our approach|the way we|standard is)\s+(.{10,60})"),
)
LEAST_LABEL = 5


def notes_of(files: DataFrame) -> DataFrame:
    """(file, label, kind, confidence_score) of what files(file, text) decide, regret and hold to; of labels that
    differ by case alone the first counts, in the order of the patterns and then of the text."""
    def hits(n: int, kind: str, sure: float, pattern: str):
        note = lambda x, i: F.struct(F.lit(n).alias("n"), i.alias("i"), F.trim(x).alias("label"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence_score"))
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), note)

    found = [hits(n, *rule[:2], rule[2]) for n, rule in enumerate(NOTE_PATTERNS)]
    # A file's rows are met by number, not by their bytes, of which there are few.
    own = dealt(files.select("file", "text"), len(NOTE_PATTERNS) * files.count(), "file")
    got = own.select("file", F.explode(F.concat(*found)).alias("x")).select("file", "x.*").filter(F.length("label") >= LEAST_LABEL)
    w = Window.partitionBy("file", F.lower("label")).orderBy("n", "i")
    return got.withColumn("first", F.row_number().over(w)).filter("first = 1").select("file", "label", "kind", "confidence_score")


def unquoted(text: str) -> str:
    """A scalar without its quotes."""
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] == "'":
        return t[1:-1].replace("''", "'")
    if len(t) >= 2 and t[0] == t[-1] == '"':
        told = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), t[1:-1])
        for mark, char in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\t", "\t"), ("\\\\", "\\")):
            told = told.replace(mark, char)
        return told
    return t


KEY = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_-]*)\s*:\s*(.*)")


def front_matter(text: str) -> tuple[dict | None, str]:
    """The fields between the first two `---` lines, and the rest; None where there are none or a line is not understood.

    Values are scalars, folded or literal blocks, and one level of named scalars.
    """
    m = re.match(r"---(.*?)\n---[^\S\n]*(?:\n|\Z)", text, re.S)
    if not m:
        return None, text
    fields: dict = {}
    key, block, style = None, [], ""

    def close() -> None:
        if style in "|>" and style and key is not None:
            fields[key] = "\n".join(block).strip() if style == "|" else " ".join(x for x in block if x.strip()).strip()

    for line in m[1].replace("\r", "").strip().split("\n"):
        inner = line[:1].isspace()
        if style and style in "|>" and (inner or not line):
            block.append(line[2:] if line.startswith("  ") else line.removeprefix("\t"))
            continue
        if style == "map" and inner and line.strip():
            if own := KEY.fullmatch(line):
                fields[key][own[1]] = unquoted(own[2])
            continue
        close()
        style = ""
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        own = None if inner else KEY.fullmatch(line)
        if own is None:
            return None, text[m.end() :]
        key, value = own[1], own[2]
        if value in ("|", ">"):
            style, block = value, []
        elif not value:
            style, fields[key] = "map", {}
        else:
            fields[key] = unquoted(value)
    close()
    return fields, text[m.end() :]


# Quotation marks of phrases that call a skill, and the words before a condition.
QUOTED = re.compile("[\"'“”‘’]([^\"'“”‘’\n]{4,100}?)[\"'“”‘’]")
USE_WHEN = re.compile(r"\bUse when\s+(.+?)(?=\.\s+[A-Z]|[\n\r]|$)")
RELATED = re.compile(r"##\s*Related Skills\s*\r?\n([\s\S]*?)(?=\r?\n##|\r?\n#[^#]|\Z)", re.I)


def triggers(text: str) -> list[str]:
    """Phrases in quotation marks, then conditions after `Use when`, each once."""
    quoted = (m.strip() for m in QUOTED.findall(text))
    when = (re.sub(r"[.,;]+$", "", m.strip()) for m in USE_WHEN.findall(text))
    return list(dict.fromkeys([*(x for x in quoted if len(x) >= 4), *(x for x in when if 0 < len(x) < 120)]))


def related_skills(body: str) -> list[str]:
    """The names in the list under `## Related Skills`."""
    m = RELATED.search(body)
    items = (re.match(r"\s*[-*+]\s+`?([a-z][a-z0-9-]*)`?", x, re.I) for x in re.split(r"\r?\n", m[1])) if m else ()
    return list(dict.fromkeys(x[1].lower() for x in items if x))


def skills(files: DataFrame) -> DataFrame:
    """(path, name, description, parsed, triggers, related) of skill files(path, text)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                fields, body = front_matter(text or "")
                told = fields or {}
                name, about = (str(told.get(k) or "") if not isinstance(told.get(k), dict) else "" for k in ("name", "description"))
                rows.append((path, name or path.rstrip("/").split("/")[-2], about, fields is not None, triggers(f"{about}\n\n{body}"), related_skills(body)))
            yield pd.DataFrame(rows, columns=["path", "name", "description", "parsed", "triggers", "related"])

    ship(files.sparkSession)
    return files.select("path", "text").mapInPandas(run, "path string, name string, description string, parsed boolean, triggers array<string>, related array<string>")


def related_edges(own: DataFrame) -> DataFrame:
    """(source, target) of skills(name, related) whose related names are skills too; none to itself."""
    named = own.select("name", F.explode("related").alias("other"))
    return named.join(own.select(F.lower("name").alias("other"), F.col("name").alias("target")), "other").filter("name <> target").select(F.col("name").alias("source"), "target").distinct()


# Commands that print a file, grep's names and flags, and marks of a command that does more.
READERS = ("cat", "head", "tail", "less", "more")
GREPS = ("rg", "grep", "egrep", "fgrep")
GREP_OTHER = {"-l", "--files-with-matches", "-L", "--files-without-match", "-c", "--count", "-o", "--only-matching", "-v", "--invert-match", "--json"}
GREP_PLAIN = {
    "--line-number", "--ignore-case", "--word-regexp", "--recursive", "--fixed-strings", "--case-sensitive", "--smart-case", "--no-heading",
    "--with-filename", "--color",
}
MARKS, GREP_MARKS = re.compile(r"""[|&;<>()$`\\*?\[\]{}"']"""), re.compile(r"[|&;<>$`\n\\()]")
FILE_MARKS, NESTED = re.compile(r"""[|&;()$`*?\[\]{}"']"""), re.compile(r"\$\(|`|<\(|>\(")


def read_path(command: str | None) -> str | None:
    """The file that a command only prints."""
    words = (command or "").split()
    plain = command and len(command) <= 200 and command == command.strip() and not MARKS.search(command) and len(words) == 2
    return words[1] if plain and words[0] in READERS and not words[1].startswith("-") else None


def grep_pattern(command: str | None) -> str | None:
    """The pattern of a plain content search."""
    if not command or len(command) > 300 or command != command.strip() or GREP_MARKS.search(command):
        return None
    words = iter(command.split())
    if next(words) not in GREPS:
        return None
    found = []
    for w in words:
        if w in ("-e", "--regexp"):
            w = next(words, "-")
            if w.startswith("-"):
                return None
            found.append(w)
        elif w in GREP_OTHER:
            return None
        elif w.startswith("--"):
            if w not in GREP_PLAIN:
                return None
        elif w.startswith("-") and len(w) > 1:
            if not re.fullmatch("[niwrRFsSH]+", w[1:]):
                return None
        else:
            found.append(w)
    return re.sub(r"^([\"'])(.*)\1$", r"\2", found[0]) or None if found else None


def file_ops(command: str | None) -> list[tuple[str, str]]:
    """(action, path) of what a command does to files: prune what goes, reindex what comes."""
    text = (command or "").strip()
    if not text or len(command) > 500 or NESTED.search(text):
        return []
    if m := re.search(r"\s+>>?\s+(\S+)\s*$", text):
        return [] if FILE_MARKS.search(text[: m.start()]) or m[1].startswith("-") else [("reindex", m[1])]
    if FILE_MARKS.search(text):
        return []
    words = text.split()
    if words[0] == "git":
        words = words[1:] if words[1:2] in (["rm"], ["mv"]) and len(words) >= 3 else [""]
    paths = [w for w in words[1:] if not w.startswith("-")]
    if words[0] == "rm":
        return [("prune", p) for p in paths]
    if words[0] in ("mv", "cp") and len(paths) == 2:
        return [("prune", paths[0])] * (words[0] == "mv") + [("reindex", paths[1])]
    return []


def shell(commands: DataFrame) -> DataFrame:
    """(seq, reads, greps, ops) of commands(seq, command): what is only printed or searched, and what is done to files."""

    def run(batches):
        for pdf in batches:
            told = [(s, read_path(c), grep_pattern(c), [{"action": a, "path": p} for a, p in file_ops(c)]) for s, c in zip(pdf["seq"], pdf["command"])]
            yield pd.DataFrame(told, columns=["seq", "reads", "greps", "ops"])

    ship(commands.sparkSession)
    return commands.select("seq", "command").mapInPandas(run, "seq long, reads string, greps string, ops array<struct<action:string,path:string>>")


# How a line of each language declares something: kind and pattern, the first that matches counts.
DECLARES = {
    "ts": (
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*[=<]"),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\("),
    ),
    "python": (("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")),
    "go": (("function", r"^func\s+(?:\([\w\s*]+\)\s+)?(\w+)\s*\("), ("interface", r"^type\s+(\w+)\s+interface\s*\{"), ("class", r"^type\s+(\w+)\s+struct\s*\{")),
    "rust": (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)"), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)")),
    "java": (("interface", r"^\s*(?:public\s+|private\s+|protected\s+)?interface\s+(\w+)"), ("class", r"^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+)*(?:class|enum)\s+(\w+)"), ("function", r"^\s+(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(")),
    "ruby": (("class", r"^\s*(?:class|module)\s+([A-Z]\w*)"), ("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")),
    "php": (("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:interface|trait)\s+(\w+)"), ("function", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*function\s+(\w+)")),
}


def declarations(lines: DataFrame) -> DataFrame:
    """(file, line, kind, name) of lines(file, lang, line, text) that declare something; comments do not."""
    rule = lambda lang, kind, p: F.struct(F.lit(kind).alias("kind"), F.when(F.col("lang") == lang, F.regexp_extract("text", p, 1)).otherwise("").alias("name"))
    found = F.filter(F.array(*(rule(lang, kind, p) for lang, rules in DECLARES.items() for kind, p in rules)), lambda x: x["name"] != "")
    told = lines.filter(~F.col("text").rlike(r"^\s*(//|\*|#)")).withColumn("found", found)
    return told.filter(F.size("found") > 0).select("file", "line", F.col("found")[0]["kind"].alias("kind"), F.col("found")[0]["name"].alias("name"))


def go_imports(lines: DataFrame) -> DataFrame:
    """(file, line, module) of lines(file, line, text): single imports, and those inside `import (` ... `)`."""
    t = F.trim("text")
    opens, closes = F.col("text").rlike(r"^import\s*\("), t == ")"
    # The state after a line is what its last mark says; a closing mark outside a block changes nothing.
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(w), F.lit(False))
    own = lines.filter(~t.rlike(r"^(//|\*)")).withColumn("inside", inside)
    single, block = F.regexp_extract("text", r'^import\s+"([^"]+)"', 1), F.regexp_extract("text", r'^\s*"([^"]+)"', 1)
    path = F.when(single != "", single).when(F.col("inside") & (block != ""), block)
    return own.withColumn("path", path).filter("path IS NOT NULL").select("file", "line", F.element_at(F.split("path", "/"), -1).alias("module"))


def python_symbols(source: str) -> tuple[list[tuple], list[tuple]]:
    """Of Python source: (name, kind, first line, last line) of what it declares, and (caller, callee, line) of its calls
    (caller: the innermost function around, or an empty text); none if it cannot be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [], []
    names, calls = [], []

    def visit(node: ast.AST, owner: str, inside: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside == "class" else "function"
                names.append((child.name, kind, child.lineno, child.end_lineno))
                visit(child, owner if kind == "class" else child.name, "class" if kind == "class" else "function")
                continue
            if isinstance(child, ast.Call):
                f = child.func
                callee = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if callee:
                    calls.append((owner, callee, child.lineno))
            visit(child, owner, inside)

    visit(tree, "", "module")
    return names, calls


CALL = re.compile(r"(?<![\w$.])(?:new\s+)?((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*)\s*\(")
# Words before a bracket that are no calls.
NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "def", "fn", "func", "match", "elif", "and", "or", "not", "in"}


def symbols(files: DataFrame) -> DataFrame:
    """(file, what, name, kind, owner, line) of files(file, lang, text): what they declare (`symbol`) and call (`call`).

    Python is parsed.  Other languages are read by patterns, which is approximate: a call is a name before a bracket.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for file, lang, text in zip(pdf["file"], pdf["lang"], pdf["text"]):
                if lang == "python":
                    names, calls = python_symbols(text or "")
                    rows += [(file, "symbol", n, k, "", a) for n, k, a, _ in names] + [(file, "call", c, "", o, a) for o, c, a in calls]
                    continue
                for i, x in enumerate((text or "").split("\n"), 1):
                    if x.lstrip().startswith(("//", "*", "#")):
                        continue
                    own = next(((k, m[1]) for k, p in DECLARES.get(lang, ()) if (m := re.match(p, x))), None)
                    if own:
                        rows.append((file, "symbol", own[1], own[0], "", i))
                    rows += [(file, "call", n.split(".")[-1], "", "", i) for n in CALL.findall(x) if n not in NO_CALLS and not (own and n == own[1])]
            yield pd.DataFrame(rows, columns=["file", "what", "name", "kind", "owner", "line"])

    ship(files.sparkSession)
    return files.select("file", "lang", "text").mapInPandas(run, "file string, what string, name string, kind string, owner string, line long")


def call_sites(callers: DataFrame, files: DataFrame, most_files: int = 15, most_sites: int = 25, most: int = 140) -> DataFrame:
    """(symbol, file, line, text) of the lines that hold a symbol, in the first most_files files of callers(symbol, file);
    at most most_sites of a symbol, each cut to `most` letters."""
    w = Window.partitionBy("symbol").orderBy("file")
    few = callers.select("symbol", "file").distinct().withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most_files).select("symbol", "file")
    lines = few.join(files.select("file", F.posexplode(F.split("text", "\n")).alias("at", "line_text")), "file")
    found = F.regexp_instr("line_text", F.concat(F.lit(r"(?<![\w$])\Q"), F.col("symbol"), F.lit(r"\E(?![\w$])"))) > 0
    hit = lines.filter(F.col("line_text").contains(F.col("symbol")) & found)
    w = Window.partitionBy("symbol").orderBy("file", "at")
    t = F.trim("line_text")
    return hit.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most_sites).select("symbol", "file", (F.col("at") + 1).cast("long").alias("line"), F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t).alias("text"))


def canonical(value) -> str:
    """JSON with sorted keys and the shortest numbers; an error for what is not finite."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("not finite")
        if value == int(value) and abs(value) < 1e21:
            return str(int(value))
        mantissa, _, power = repr(value).partition("e")
        return mantissa.removesuffix(".0") + (f"e{'-' if power[0] == '-' else '+'}{power.lstrip('+-').lstrip('0')}" if power else "")
    return json.dumps(value, ensure_ascii=False)
