"""Quotation linking for conversations.

A message's lines are parsed into passages by quote level (leading `>` signs).  Every message's own
passages (level 0, and the whole own text) are hashed after normalisation, as are the quoted ones and the parts of
both: their lines and sentences of PART words and more.  A quoted passage is joined to the earliest message
that holds it whole, else to one that holds a part of it: one of an earlier turn in the same conversation,
else the earliest of another conversation.  A message replies to the latest earlier turn among its level-1
matches.  Replies stand behind the message they reply to, in turn order; messages
without a match stand at the top level in turn order, so a conversation without quotes keeps its order.
The text loses its quotes and the lines that introduce them; in fenced code blocks `>` is no quote.

Result: conv_id, turn, role, text (own text), parent_turn, other_conv and other_turn (match elsewhere),
depth, path (turns from the top message down, as fixed-width hexadecimal: sorting conv_id, path gives the reading order),
n_quotes, n_linked.  Rows stay rows: a conversation is never gathered in one task.

Edge cases: null texts have no passages and stay null; a null conv_id or turn matches nothing;
messages with the same conv_id and turn share their links; quotes of quotes link by their own level;
very long texts are taken whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, saved

QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)")
INTRO = re.compile(r"(?i)^[ \t]*(?:on\b.*\bwrote|.{0,80}\b(?:wrote|said|writes|schrieb|a écrit|escribió))[ \t]*:[ \t]*$")
NOT_WORD = re.compile(r"[\W_]+")
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
INTRO_LINES, INTRO_LETTERS = 3, 240
PART = 4  # words
SCHEMA = "conv_id long, turn long, role string, text string, linked_text string, n_quotes long, own array<long>, quotes array<struct<level:int,passage:long,hash:long>>"


def fences(lines: list[str]) -> dict[int, tuple[int, int]]:
    """Of each line inside a fenced block, its fences included: the block's quote level, and where the line's own text
    begins.  A fence that nothing closes at its level opens no block."""
    levels = [(m[1].count(">"), m.end()) if (m := QUOTE.match(x)) else (0, 0) for x in lines]
    found = {i: m for i, (_, end) in enumerate(levels) if (m := FENCE.match(lines[i], end))}
    closing: dict[tuple[int, str], list[int]] = {}  # bare fences of each level and kind
    for i, m in found.items():
        if not lines[i][m.end() :].strip():
            closing.setdefault((levels[i][0], m[1][0]), []).append(i)
    below: dict[int, list[int]] = {}  # lines of less than a level
    out: dict[int, tuple[int, int]] = {}
    done = -1
    for i, m in found.items():
        level = levels[i][0]
        own = closing.get((level, m[1][0]), [])
        if i <= done or not own:
            continue
        if level not in below:
            below[level] = [j for j, (x, _) in enumerate(levels) if x < level]
        ends = below[level][k] if (k := bisect_right(below[level], i)) < len(below[level]) else len(lines)
        close = next((j for j in own[bisect_right(own, i) :] if j > ends or len(found[j][1]) >= len(m[1])), ends)
        if close >= ends:
            continue
        for j in range(i, close + 1):
            at = 0
            for _ in range(level):
                at = lines[j].index(">", at) + 1
            out[j] = level, at + (level > 0 and lines[j][at : at + 1] == " ")
        done = close
    return out


def passages(text: str) -> list[tuple[int, str]]:
    """(level, text) of the runs of lines of one quote level; blank lines end a passage, but for those of fenced blocks,
    in which `>` is no quote."""
    out: list[tuple[int, list[str]]] = []
    fresh = True
    lines = text.split("\n")
    fenced = fences(lines) if "```" in text or "~~~" in text else {}
    for i, line in enumerate(lines):
        if i in fenced:
            level, at = fenced[i]
            body = line[at:]
        else:
            m = QUOTE.match(line)
            level = m[1].count(">") if m else 0
            body = line[m.end() :] if m else line
            if not body.strip():
                fresh = True
                if level == 0 and out and out[-1][0] == 0:
                    out[-1][1].append("")  # blank lines between own paragraphs stay
                continue
        if fresh or not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(body)
        fresh = False
    return [(level, "\n".join(lines)) for level, lines in out]


def own_text(parts: list[tuple[int, str]], linked: bool) -> str:
    """The level-0 passages without the lines that introduce a quote: a line that says who wrote, and, if the quotes are
    known to be other messages' (linked), any paragraph of at most INTRO_LINES lines and INTRO_LETTERS letters that ends in `:`."""
    out = []
    for i, (level, body) in enumerate(parts):
        if level:
            continue
        lines = body.split("\n")
        while lines and not lines[-1]:
            lines.pop()
        if i + 1 < len(parts) and parts[i + 1][0] and lines and lines[-1].rstrip().endswith(":"):
            # Lines after the last blank one.
            begin = max((k + 1 for k, x in enumerate(lines) if not x.strip()), default=0)
            short = len(lines) - begin <= INTRO_LINES and sum(map(len, lines[begin:])) <= INTRO_LETTERS
            if linked and short:
                del lines[begin:]
            elif INTRO.match(lines[-1]):
                lines.pop()
        while lines and not lines[-1]:
            lines.pop()
        if lines:
            out.append("\n".join(lines))
    return "\n\n".join(out)


def _hashed(plain: str) -> int:
    return int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _plain(body: str) -> str:
    return NOT_WORD.sub(" ", body.lower()).strip()


def passage_hash(body: str) -> int | None:
    """64 bits of a passage's words in lower case; passages without words have none."""
    plain = _plain(body)
    return _hashed(plain) if plain else None


def part_hashes(body: str) -> set[int]:
    """Hashes of a passage's lines and sentences of PART words and more."""
    parts = {_plain(x) for x in [*body.split("\n"), *SENTENCE.split(body)]}
    return {_hashed(x) for x in parts if x.count(" ") >= PART - 1}


def parse(text: str | None) -> tuple[str | None, str | None, int, list[int], list[dict]]:
    """Own text, and what it is if the quotes are linked; number of quoted passages, hashes of the own passages and their parts, and of the quoted
    ones by level (a part's with its passage's)."""
    if text is None:
        return None, None, 0, [], []
    if ">" not in text:
        own, parts = text, [(0, p) for p in re.split(r"\n[ \t]*\n", text)]
        linked = own
    else:
        parts = passages(text)
        own, linked = (own_text(parts, x) for x in (False, True)) if any(level for level, _ in parts) else (text, text)
    hashes, quotes, n = {passage_hash(own), passage_hash(linked)}, set(), 0
    for level, body in parts:
        h = passage_hash(body)
        if h is not None and level:
            n += 1
            quotes |= {(level, h, x) for x in part_hashes(body) | {h}}
        elif h is not None:
            hashes |= part_hashes(body) | {h}
    return own, linked, n, sorted(hashes - {None}), [{"level": level, "passage": p, "hash": h} for level, p, h in sorted(quotes)]


def link_quotes(messages: DataFrame, max_rounds: int = 40) -> DataFrame:
    def make():
        def run(convs, turns, roles, texts):
            got = [parse(t) for t in texts]
            return [convs, turns, roles, *map(list, zip(*got))]

        return run

    told = saved(arrow_map(messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")), make, SCHEMA))
    base = told.select("conv_id", "turn", "role", "text", "linked_text", "n_quotes")
    quotes = told.filter("n_quotes > 0").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    # Only hashes that something quotes are worth looking up; one row for each conversation and hash.
    own = told.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("own").alias("hash")).join(quotes.select("hash").distinct(), "hash", "left_semi")
    first = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("at"))
    # The two least conversations of each hash: one of them at least is not the quoting message's own.
    least = first.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).filter("n <= 2").withColumn("holder", F.struct("conv_id", F.col("at").alias("turn")))
    anywhere = least.groupBy("hash").agg(F.max(F.when(F.col("n") == 1, F.col("holder"))).alias("one"), F.max(F.when(F.col("n") == 2, F.col("holder"))).alias("two"))
    elsewhere = F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one")).when(F.col("conv_id").isNotNull(), F.col("two"))
    whole = F.col("hash") == F.col("passage")
    matched = (
        quotes.join(first, ["conv_id", "hash"], "left").withColumn("at", F.when(F.col("at") < F.col("turn"), F.col("at")))
        .join(anywhere, "hash", "left").withColumn("other", F.when(F.col("at").isNull(), elsewhere))
        .groupBy("conv_id", "turn", "level", "passage").agg(*(F.coalesce(f(F.when(whole, F.col(c))), f(F.when(~whole, F.col(c)))).alias(c) for c, f in (("at", F.max), ("other", F.min))))
        .withColumn("other", F.when(F.col("at").isNull(), F.col("other")))
        .groupBy("conv_id", "turn").agg(F.max(F.when(F.col("level") == 1, F.col("at"))).alias("parent_turn"), F.min("other").alias("other"), F.count(F.coalesce(F.col("at"), F.col("other.turn"))).alias("n_linked"))
    )
    matched = saved(matched)
    links = matched.filter(F.col("parent_turn").isNotNull()).select("conv_id", "turn", "parent_turn")
    paths = _paths(links, max_rounds)
    return (
        base.join(matched, ["conv_id", "turn"], "left").join(paths, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", F.when(F.col("n_linked") > 0, F.col("linked_text")).otherwise(F.col("text")).alias("text"), "parent_turn", F.col("other.conv_id").alias("other_conv"), F.col("other.turn").alias("other_turn"),
                F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("path", _step("turn")).alias("path"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    )


def _step(turn: str):
    return F.lpad(F.hex(F.col(turn)), 16, "0")


def _paths(links: DataFrame, max_rounds: int) -> DataFrame:
    """conv_id, turn, depth and path of the linked messages, by pointer doubling: as many rounds as the
    longest chain's logarithm, each written to the shared folder."""
    state = links.select("conv_id", "turn", F.col("parent_turn").alias("top"), F.lit(1).cast("long").alias("depth"), F.concat_ws("/", _step("parent_turn"), _step("turn")).alias("path"))
    for _ in range(max_rounds):
        up = state.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        if not state.join(up, ["conv_id", "top"], "left_semi").limit(1).count():
            break
        state = saved(
            state.join(up, ["conv_id", "top"], "left")
            .select("conv_id", "turn", F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
                    F.when(F.col("path2").isNotNull(), F.concat("path2", F.expr("substr(path, 17)"))).otherwise(F.col("path")).alias("path"))
        )
    return state.drop("top")
