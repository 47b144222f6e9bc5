"""Columns that parse paths, subjects, markers, versions and declarations."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what an identifier looks like.
IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*"


def bare_identifier(c: Column) -> Column:
    """The last dotted part before any bracket; null where that is no identifier."""
    x = F.trim(F.element_at(F.split(F.regexp_replace(c, r"\(.*", ""), r"\."), -1))
    return F.when(x.rlike(rf"\A{IDENT}\z"), x)


def semver(c: Column) -> Column:
    """A version's numbers; arrays compare part by part."""
    return F.transform(F.split(F.regexp_replace(c, "^v", ""), r"\."), lambda x: x.cast("int"))


def fingerprint(c: Column) -> Column:
    """SHA-256 in base64url without padding."""
    return F.translate(F.regexp_replace(F.base64(F.unhex(F.sha2(c, 256))), "=+$", ""), "+/", "-_")


def canonical_json(c: Column) -> Column:
    """A flat object of numbers, its keys sorted, without spaces."""
    pairs = F.array_sort(F.map_entries(F.from_json(c, "map<string,bigint>")))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"].cast("string"))), ","), F.lit("}"))


def fill(template: str, **values: Column) -> Column:
    """Each `{name}` of the template by its value."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def markers(c: Column, start: str, end: str) -> Column:
    """none, balanced or unbalanced: the markers outside fenced blocks."""
    bare = F.regexp_replace(c, r"(?s)```.*?```", "")
    count = lambda m: F.size(F.split(bare, m)) - 1
    a, b = count(start), count(end)
    return F.when((a == 0) & (b == 0), "none").when(a == b, "balanced").otherwise("unbalanced")


def revert_subject(c: Column) -> Column:
    """The subject that a revert's subject quotes, else the subject without the word."""
    x = F.regexp_extract(c, r'(?i)^Revert\s+"(.+)"\s*$', 1)
    return F.when(x != "", x).otherwise(F.regexp_replace(c, r"(?i)^Revert\s+", ""))


def revert_pattern(files: Column) -> Column:
    """What a revert touched: the folder of all its files, else the first file's stem."""
    dirs = F.array_distinct(F.transform(files, lambda f: F.regexp_extract(f, "^(.*)/[^/]*$", 1)))
    first = F.regexp_replace(F.element_at(F.split(F.get(files, F.lit(0)), "/"), -1), r"\.[^.]+$", "")
    one = (F.size(dirs) == 1) & (F.get(dirs, F.lit(0)) != "")
    return F.when(F.size(files) == 0, "git revert").when(one, F.concat(F.lit("git revert in "), F.get(dirs, F.lit(0)), F.lit("/"))).otherwise(F.concat(F.lit("git revert touching "), first))


def number(v: Column) -> Column:
    return F.when(v >= 1_000_000, F.format_string("%.2fM", F.round(v / 1_000_000, 2))).when(v >= 1000, F.format_string("%.1fK", F.round(v / 1000, 1))).otherwise(F.floor(v + 0.5).cast("string"))


def percent(v: Column) -> Column:
    return F.format_string("%.1f%%", F.round(v * 100, 1))


def usd(v: Column) -> Column:
    return F.when(v >= 1, F.format_string("$%.2f", v)).when(v >= 0.01, F.format_string("$%.3f", v)).otherwise(F.format_string("$%.4f", v))


def ratio_phrase(r: Column) -> Column:
    """How a packet compares with what it stands for; a larger one is never called smaller."""
    back = F.floor(F.lit(1.0) / r * 10 + 0.5) / 10
    return F.when(F.isnan(r) | (r <= 0), "n/a").when(r >= 1, F.concat(r.cast("string"), F.lit("x smaller packet"))).otherwise(F.concat(back.cast("string"), F.lit("x LARGER: passed through")))


def memory_score(title: Column, about: Column, path: str, imports: tuple[str, ...] = ()) -> Column:
    """How well a memory entry fits a file: its name in the title (3) and in the text (2), an import (2), a folder (1)."""
    t, d = F.lower(title), F.lower(about)
    parts = [p for p in re.split(r"[\\/]", path) if p]
    name = re.sub(r"\.[^.]+$", "", parts[-1]).lower() if parts else ""
    either = lambda words: reduce(operator.or_, [t.contains(w.lower()) | d.contains(w.lower()) for w in words if len(w) > 2], F.lit(False))
    score = F.when(either(imports), 2).otherwise(0) + F.when(either(parts), 1).otherwise(0)
    if len(name) > 2:
        score = score + F.when(t.contains(name), 3).otherwise(0) + F.when(d.contains(name), 2).otherwise(0)
    return score


def injected_tokens(response: Column) -> Column:
    """A quarter of the characters that a hook's answer puts into the context: its reason, else its additional context."""
    at = lambda k: F.nullif(F.get_json_object(response, f"$.hookSpecificOutput.{k}"), F.lit(""))
    return F.coalesce(F.ceil(F.length(F.coalesce(at("permissionDecisionReason"), at("additionalContext"))) / 4), F.lit(0)).cast("long")


def output_size(answer: Column) -> Column:
    """Characters of a tool's answer, given as JSON `{"v": answer}`: of the text, of its field `output`, else of its JSON."""
    v = F.get_json_object(answer, "$.v")
    return F.length(F.coalesce(F.get_json_object(answer, "$.v.output"), v)).cast("long")


# Endings of files that hold no text, and names and endings of files that hold secrets.
BINARY = (
    "png jpg jpeg gif webp ico bmp tiff svg pdf doc docx xls xlsx ppt pptx zip tar gz tgz bz2 xz 7z rar exe dll so dylib o a class wasm "
    "mp3 mp4 m4a wav flac ogg avi mov mkv webm bin dat db sqlite parquet ttf otf woff woff2 eot"
).split()
SECRET_NAMES = (".env", "secrets.json", "secrets.yaml", "secrets.yml", "credentials", "credentials.json", "config.secret.json", "id_rsa", "id_ed25519", "id_ecdsa", "id_dsa")
SECRET_ENDINGS = (".pem", ".key", ".p12", ".pfx", ".keystore")


def path_state(path: Column) -> Column:
    """system, exempt, binary, secret or safe: whether a file may be read for its content, the first that holds."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    up, base = F.upper(p), F.lower(F.element_at(F.split(p, "/"), -1))
    system = (p == "") | (p == "/") | p.rlike("^/(dev|proc|sys)/") | up.rlike("^//[.?]/") | up.rlike("^[A-Z]:/(WINDOWS|PROGRAM FILES|PROGRAMDATA)(/|$)")
    exempt = p.contains("/node_modules/") | p.contains("/.git/")
    binary = F.lower(F.regexp_extract(p, r"\.([^.]*)$", 1)).isin(*BINARY)
    secret = base.isin(*SECRET_NAMES) | base.startswith(".env.") | reduce(operator.or_, [base.endswith(x) for x in SECRET_ENDINGS])
    return F.when(system, "system").when(exempt, "exempt").when(binary, "binary").when(secret, "secret").otherwise("safe")


def kept_lines(c: Column, budget: Column | int = 200) -> Column:
    """How many whole lines, one token more for each, a budget of tokens takes."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s: Column, line: Column) -> Column:
        used = s["used"] + F.ceil(F.length(line) / 4) + 1
        fits = s["open"] & (used <= budget)
        return F.struct(F.when(fits, used).otherwise(s["used"]).alias("used"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), fits.alias("open"))

    return F.aggregate(F.split(c, "\n"), zero, step, lambda s: s["n"])


def cut_lines(c: Column, budget: Column | int = 200) -> Column:
    """The whole lines within a budget of tokens; else as many characters."""
    n = kept_lines(c, budget)
    chars = F.lit(4 * budget) if isinstance(budget, int) else (4 * budget).cast("int")
    return F.when(n > 0, F.array_join(F.slice(F.split(c, "\n"), 1, F.greatest(n, F.lit(1))), "\n")).otherwise(F.substring(c, F.lit(1), chars))
