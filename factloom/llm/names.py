"""Spellings of one person or organisation linked, within an instance.

Names are cut into tokens without accents, case, legal forms and titles. Blocks are formed by the phonetic codes of sorted sounds of
one token and the first letter of another, over all orders of tokens; a code also comes with each of its sounds left out, so that
misspelt sounds still meet, and nicknames add their formal names. Pairs within a block are compared token by token with
Jaro-Winkler, edit distance and the nickname table. Accepted pairs of full names are clustered by connected components. Shortened
names (initials, cut words, acronyms) are then tied to the cluster they fit, if they fit exactly one; those that fit none are
clustered among themselves.

Rows with the same tokens are one node from the start, so repeats cost nothing in the blocks. An instance's rows of one type come
together in one task, by a single shuffle of the table, and all steps are taken there; where they are counted to be too many for that,
the same steps are joins, whose blocks shuffle hashes and node ids only. Rows with a null or blank name, instance or type are never
linked, nor are types other than person and org, nor the speakers themselves (user, assistant).
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import combinations, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.components import components
from factloom.session import spread, written

# Short forms of given names.
NICKNAMES = {
    "abigail": ["abby", "gail"], "abraham": ["abe"], "akhilesh": ["akhil"], "albert": ["al", "bert", "bertie"], "aleksander": ["alek", "olek"], "alexander": ["alex", "sandy", "xander"], "alexandra": ["alex", "sandra", "sasha"],
    "alfred": ["alf", "fred"], "amanda": ["mandy"], "andrew": ["andy", "drew"], "anthony": ["tony"], "antonio": ["toni"], "archibald": ["archie"], "arthur": ["art"], "barbara": ["babs", "barb"], "bartholomew": ["bart"],
    "beatrice": ["bea", "trixie"], "benjamin": ["ben", "benny"], "bernard": ["bernie"], "bridget": ["biddy"], "catherine": ["cathy", "kate", "kitty"], "charles": ["charlie", "chuck"], "charlotte": ["lottie"], "christina": ["tina", "chris"],
    "christopher": ["chris", "kit"], "cynthia": ["cindy"], "daniel": ["dan", "danny"], "david": ["dave", "davy"], "deborah": ["deb", "debbie"], "dorothea": ["dorrie", "dora", "thea"], "dorothy": ["dot", "dottie"], "edward": ["ned", "ted", "teddy", "ed", "eddie"],
    "eleanor": ["ellie", "nell", "nora"], "elizabeth": ["liz", "beth", "betty", "eliza", "lizzie"], "emily": ["em", "millie"], "eugene": ["gene"], "florence": ["flo"], "frances": ["fran", "frankie"], "francisco": ["paco", "pancho"], "franklin": ["frank"],
    "frederica": ["freddie", "fred", "rica"], "frederick": ["fred", "freddie"], "gabriela": ["gabi", "gaby"], "gabriel": ["gabe"], "geoffrey": ["geoff"], "gerald": ["gerry"], "giuseppe": ["beppe"], "gregory": ["greg"], "guillermo": ["memo"],
    "harold": ["harry", "hal"], "henrietta": ["etta", "hettie"], "henry": ["hank", "harry"], "ignacio": ["nacho"], "isabella": ["izzy", "bella"], "jacob": ["jake"], "james": ["jim", "jimmy", "jamie"], "jennifer": ["jen", "jenny"], "jessica": ["jess"],
    "johannes": ["hannes", "jo"], "john": ["jack", "johnny"], "jonathan": ["jon", "jonny", "johnny"], "jose": ["pepe"], "joseph": ["joe", "joey"], "joshua": ["josh"], "josephine": ["josie"], "judith": ["judy"], "katherine": ["kate", "kitty", "kathy", "katie"],
    "kenneth": ["ken", "kenny"], "lawrence": ["larry"], "leonard": ["leo", "len", "lenny"], "leopold": ["leo", "poldi"], "louise": ["lou"], "margaret": ["maggie", "peggy", "meg", "greta"], "matthew": ["matt"], "meiling": ["mei"], "michael": ["mike", "mick"],
    "mikhail": ["misha"], "monica": ["moni"], "nathaniel": ["nate", "nat", "nathan"], "nicholas": ["nick", "nicky"], "nikolai": ["kolya"], "octavia": ["tavi"], "oliver": ["ollie"], "pamela": ["pam"], "patricia": ["pat", "patty", "tricia"], "patrick": ["pat", "paddy"],
    "penelope": ["penny", "nell"], "peter": ["pete"], "philip": ["phil", "pip"], "priyanka": ["priya"], "quentin": ["quinn"], "rajendra": ["raj"], "raymond": ["ray"], "rebecca": ["becky"], "richard": ["dick", "rick", "rich"], "robert": ["rob", "bob", "bobby"],
    "rosemary": ["rosie"], "samantha": ["sam"], "samuel": ["sam", "sammy"], "sebastian": ["seb", "basti"], "stanley": ["stan"], "stephanie": ["steph", "steffi"], "stephen": ["steve"], "susan": ["sue", "suzie"], "theodora": ["thea", "dora", "teddy", "dorrie"],
    "theodore": ["ted", "theo"], "thomas": ["tom", "tommy"], "timothy": ["tim"], "ulrike": ["uli", "ulli"], "valentina": ["val", "tina"], "veronique": ["vero"], "victoria": ["vicky", "tori"], "vincent": ["vince"], "vladimir": ["vova"], "walter": ["walt"],
    "wilhelm": ["willi"], "william": ["bill", "liam", "will", "billy"], "winifred": ["winnie"], "xaviera": ["xavi"], "yekaterina": ["katya"], "yolanda": ["yoli"], "zachary": ["zach", "zack"],
}
# Legal forms, articles and titles that are no part of a name.
LEGAL = {"inc", "llc", "ltd", "gmbh", "co", "corp", "plc", "sa", "ag", "bv", "the", "limited", "company"}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "frau", "herr", "fr", "hr", "mme", "sra"}
LETTERS = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe"}


def plain(text: str) -> str:
    low = unicodedata.normalize("NFKD", text).lower()
    return "".join(LETTERS.get(c, c) for c in low if not unicodedata.combining(c))


_ACRONYM = re.compile(r"^(?:[A-Z]\.?){2,6}$")


def tokens(name: str | None, kind: str) -> str:
    """The tokens of a name in order, separated by spaces; a cut one ends in a dot, an acronym begins with =."""
    text = unicodedata.normalize("NFKC", name or "").strip()
    if kind == "org" and _ACRONYM.match(text):
        return "=" + plain(text.replace(".", ""))
    text = re.sub(r"\bGmbH\b", "gmbh", text)
    if text != text.upper():
        split = []
        for i, c in enumerate(text):
            if i > 1 and c.isupper() and text[i - 1].islower() and text[i - 2].isalpha():
                split.append(" ")
            split.append(c)
        text = "".join(split)
    if kind == "person":
        family, comma, given = text.partition(",")
        text = f"{given} {family}" if comma else text
        words = [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*-?\.?", plain(text))]
        words = [w.replace("-", "").replace("'", "").replace("’", "") for w in words]
        words = [w.rstrip(".") if len(w.rstrip(".")) == 1 else w for w in words if w.rstrip(".") not in TITLES]
    else:
        words = re.findall(r"\w+\.?", plain(text).replace("_", " "))
        words = [w for w in words if w.rstrip(".") not in LEGAL]
    return " ".join(words)


def weak(t: str) -> bool:
    return len(t) == 1 or t.endswith(".") or t.startswith("=")


# The digit of each consonant in the Soundex code.
_CODE = {**dict.fromkeys("bfpv", "1"), **dict.fromkeys("cgjkqsxz", "2"), **dict.fromkeys("dt", "3"), "l": "4", **dict.fromkeys("mn", "5"), "r": "6"}


@functools.lru_cache(1 << 16)
def phonetic(t: str) -> str:
    """Soundex of a token, on its letters."""
    out, last = t[:1], _CODE.get(t[:1], "")
    for c in t[1:]:
        d = _CODE.get(c, "")
        if d and d != last:
            out += d
        if c not in "hw":
            last = d
    return (out + "000")[:4]


@functools.lru_cache(1 << 16)
def sounds(t: str) -> frozenset[str]:
    """The first letter with the digits of all further consonants in order of size, and the same with one of them left out."""
    ds = sorted(_CODE[c] for c in t[1:] if c in _CODE)
    return frozenset({f"{t[0]}~{''.join(ds)}"} | {f"{t[0]}~{''.join(ds[:i] + ds[i + 1 :])}" for i in range(len(ds)) if len(ds) > 1})


_FORMAL: dict[str, set[str]] = {}
for _f, _short in NICKNAMES.items():
    for _t in _short:
        _FORMAL.setdefault(_t, {_t}).add(_f)


def formal(t: str) -> set[str]:
    """t, and the given names that it is short for."""
    return _FORMAL.get(t) or {t}


def block_keys(norm: str) -> list[str]:
    ts = norm.split()
    if not ts:
        return []
    if norm[0] == "=":
        return ["=" + "".join(sorted(norm[1:]))]
    keys = {"=" + "".join(sorted(t[0] for t in ts))} if len(ts) >= 3 else set()
    for i, a in enumerate(ts):
        if weak(a):
            continue
        forms = formal(a)
        keys |= {f"1|{phonetic(f)}" for f in forms}  # only for names of one token, see compared()
        firsts = {f[0] for j, b in enumerate(ts) if j != i for f in formal(b)}
        keys |= {f"{x}|{c}" for f in forms for x in sounds(f) for c in firsts}
    return sorted(keys)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used, ma = [False] * lb, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                ma.append(c)
                break
    if not ma:
        return 0.0
    mb = [b[j] for j in range(lb) if used[j]]
    m, t = len(ma), sum(x != y for x, y in zip(ma, mb, strict=True)) / 2
    jaro = (m / la + m / lb + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, la, lb) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def osa(a: str, b: str) -> int:
    """Edits between a and b, a swap of neighbours counting as one."""
    if abs(len(a) - len(b)) > 2:
        return 3
    before, last, row = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = last, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[j] = min(row[j], before[j - 2] + 1)
    return row[-1]


#: Jaro-Winkler similarity from which two tokens may be one misspelt.
ALIKE = 0.84


@functools.lru_cache(1 << 17)
def alike(a: str, b: str) -> int:
    """0: not one token; 1: one cut short; 2: misspelt; 3: equal or a nickname."""
    if a == b:
        return 1 if weak(a) else 3
    if weak(a) or weak(b):
        x, y = (a.rstrip("."), b.rstrip(".")) if len(a) < len(b) or (a.endswith(".") and not b.endswith(".")) else (b.rstrip("."), a.rstrip("."))
        return 1 if any(f.startswith(x) for f in formal(y)) or (len(x) > 3 and osa(x, y[: len(x)]) <= 1) else 0
    if formal(a) & formal(b) or a in formal(b) or b in formal(a):
        return 3
    if min(len(a), len(b)) >= 3 and jaro_winkler(a, b) >= ALIKE:
        d = osa(a, b)
        if d <= 1 or (d == 2 and min(len(a), len(b)) >= 9):
            return 2
    return 0


def _shapes(ts: list[str]) -> list[list[str]]:
    """ts, and ts with two neighbours written together."""
    return [ts] + [[*ts[:i], ts[i] + ts[i + 1], *ts[i + 2 :]] for i in range(len(ts) - 1) if len(ts) > 2 and not weak(ts[i]) and not weak(ts[i + 1])]


def _aligned(a: list[str], b: list[str], kind: str) -> int:
    """0 or the least likeness of the tokens of the shorter list, each with its own partner in the longer one."""
    if len(a) > len(b):
        a, b = b, a
    left, least, full = list(b), 3, 0
    for x in sorted(a, key=weak):
        best = max(left, key=lambda y: alike(x, y), default="")
        k = alike(x, best) if best else 0
        if not k:
            return 0
        full += k >= 2
        least = min(least, k)
        left.remove(best)
    if not full:
        return 0
    if kind == "person":  # what is over may only be a middle initial
        return least if all(len(y) == 1 for y in left) and len(a) >= 2 else 0
    if left:  # an organisation's cut word stands for the words after it too
        return 1 if len(a) == 2 and any(weak(x) for x in a) else 0
    return least


def compare(a: str, b: str, kind: str) -> int:
    """0: different; 1: they fit, one being cut short; 2 or 3: the same."""
    if a[0] == "=" or b[0] == "=":
        if a[0] == b[0]:
            return 0
        x, y = (a, b) if a[0] == "=" else (b, a)
        ts = y.split()
        return int(len(ts) > 2 and x[1:] == "".join(t[0] for t in ts))
    ta, tb = a.split(), b.split()
    if len(ta) == 1 and len(tb) == 1:
        return alike(ta[0], tb[0]) if not weak(a) and not weak(b) else 0
    if kind == "person" and 1 in (len(ta), len(tb)):
        one, more = (ta, tb) if len(ta) == 1 else (tb, ta)
        return int(any(alike(one[0], x) >= 2 for x in more) or alike(one[0], "".join(more[:-1])) >= 2)
    return max(_aligned(x, y, kind) for x in _shapes(ta) for y in _shapes(tb))


def cut_short(norm: str, kind: str) -> bool:
    """Whether a name leaves open which full name it stands for. A middle initial doesn't."""
    ts = norm.split()
    return norm.startswith("=") or sum(not weak(t) for t in ts) < (1 if kind == "org" and len(ts) == 1 else 2)


# Names of the speakers themselves.
SPEAKERS = ("user", "assistant")
#: Rows of an instance and type up to which one task takes them all.
GROUP = 2000
#: Rows of a result that are sent at once.
BATCH = 50_000


def rows(entities: DataFrame) -> DataFrame:
    """vid, instance_id, kind, name of each row of a type that may be linked, without the speakers as they are mostly written."""
    e = entities.select("vid", "instance_id", F.col("entity_type").alias("kind"), "name")
    return e.where("kind in ('person', 'org') and instance_id is not null and vid is not null and name is not null").where(~F.col("name").isin(*SPEAKERS))


def nodes(named: DataFrame) -> DataFrame:
    """vid, instance_id, kind, norm of each of the rows that may be linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["norm"] = [tokens(n, k) for n, k in zip(b["name"], b["kind"], strict=True)]
            yield b[~b["norm"].isin(["", *SPEAKERS])][["vid", "instance_id", "kind", "norm"]]

    return named.mapInPandas(run, "vid bigint, instance_id string, kind string, norm string")


def compared(reps: DataFrame) -> DataFrame:
    """a, b (norms' ids), same (1 to 3), weak_a, weak_b of each pair in a block that fits."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(keys=[block_keys(n) for n in b["norm"]]).drop(columns="norm")

    k = reps.mapInPandas(keyed, "node bigint, instance_id string, kind string, keys array<string>").select("node", "instance_id", "kind", F.explode("keys").alias("key")).select("node", F.xxhash64("instance_id", "kind", "key").alias("h"), F.col("key").startswith("1|").alias("single"))
    # Both sides carry the same columns, so that they are made and shuffled once.
    l, r = k.select("h", F.col("node").alias("a"), F.col("single").alias("_s")), k.select("h", F.col("node").alias("b"), F.col("single").alias("_t"))
    met = l.join(r, "h").where("a < b").groupBy("a", "b").agg(F.min(F.col("_s") | F.col("_t")).alias("single"))
    side = lambda n, c: reps.select(F.col("node").alias(n), F.struct("instance_id", "kind").alias(f"_{n}"), F.col("norm").alias(c))
    one = lambda c: ~F.col(c).contains(" ")
    # Hashes that meet by chance are told apart here; a code alone joins only names of one token.
    pairs = met.join(side("a", "x"), "a").join(side("b", "y"), "b").where((F.col("_a") == F.col("_b")) & (~F.col("single") | one("x") | one("y"))).select("a", "b", F.col("_a.kind").alias("kind"), "x", "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["same"] = [compare(x, y, k) for x, y, k in zip(b["x"], b["y"], b["kind"], strict=True)]
            b = b[b["same"] > 0]
            yield b.assign(weak_a=[cut_short(x, k) for x, k in zip(b["x"], b["kind"], strict=True)], weak_b=[cut_short(y, k) for y, k in zip(b["y"], b["kind"], strict=True)])[["a", "b", "same", "weak_a", "weak_b"]]

    return pairs.mapInPandas(run, "a bigint, b bigint, same int, weak_a boolean, weak_b boolean")


def joined(named: DataFrame) -> DataFrame:
    """vid, cluster, links by joins, for rows of one instance that no task can take together."""
    n = written(nodes(named), "names")
    reps = written(n.groupBy("instance_id", "kind", "norm").agg(F.min("vid").alias("node")).select("node", "instance_id", "kind", "norm"), "names")
    fits = written(compared(reps), "names")
    strong = written(components(fits.where("same >= 2 and not weak_a and not weak_b"), "a", "b"), "names")
    # Cut names: the clusters that each fits. A full name without a cluster is one of its own.
    one_weak = fits.where("weak_a <> weak_b").select(F.expr("if(weak_a, a, b)").alias("cut"), F.expr("if(weak_a, b, a)").alias("node"))
    held = one_weak.join(strong, "node", "left").select("cut", "node", F.coalesce("component", "node").alias("c"))
    choice = held.groupBy("cut").agg(F.min("c").alias("c"), F.max("c").alias("most"))
    tied = choice.where("c = most").select(F.col("cut").alias("node"), F.col("c").alias("component"))
    loose = fits.where("weak_a and weak_b")
    loose = loose.join(choice.select(F.col("cut").alias("a")), "a", "left_anti").join(choice.select(F.col("cut").alias("b")), "b", "left_anti").select("a", "b")
    # A node is in one of the three: full names, cut ones that fit one cluster, cut ones that fit none.
    final = strong.unionByName(tied).unionByName(components(loose, "a", "b"))
    count = fits.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    placed = reps.join(final, "node", "left").join(count, "node", "left").select("instance_id", "kind", "norm", F.coalesce("component", "node").alias("cluster"), F.coalesce("links", F.lit(0)).alias("links"))
    return n.join(placed, ["instance_id", "kind", "norm"]).select("vid", "cluster", "links")


def settled(named: dict[str, int], kind: str) -> dict[str, tuple[int, int]]:
    """Cluster and links of each name of one instance and kind, given with their nodes: what joined() finds by joins."""
    order = sorted(named, key=named.__getitem__)
    blocks: dict[str, list[int]] = {}
    if len(order) > 1:
        for i, n in enumerate(order):
            for key in block_keys(n):
                blocks.setdefault(key, []).append(i)
    one = [" " not in n for n in order]
    # A code alone joins only names of one token.
    met = {p for key, at in blocks.items() if len(at) > 1 for p in combinations(at, 2) if one[p[0]] or one[p[1]] or not key.startswith("1|")}
    fits = [(i, j, same) for i, j in met if (same := compare(order[i], order[j], kind))]
    cut = [cut_short(n, kind) for n in order] if fits else []
    root, links = list(range(len(order))), [0] * len(order)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def tie(i: int, j: int) -> None:
        i, j = top(i), top(j)
        root[max(i, j)] = min(i, j)

    for i, j, same in fits:
        links[i] += 1
        links[j] += 1
        if same >= 2 and not cut[i] and not cut[j]:
            tie(i, j)
    # Cut names: the clusters that each fits. Those that fit none are tied among themselves.
    choice: dict[int, set[int]] = {}
    for i, j, _ in fits:
        if cut[i] != cut[j]:
            choice.setdefault(i if cut[i] else j, set()).add(top(j if cut[i] else i))
    for i, j, _ in fits:
        if cut[i] and cut[j] and i not in choice and j not in choice:
            tie(i, j)
    for i, c in choice.items():
        if len(c) == 1:
            root[i] = c.pop()
    return {n: (named[order[top(i)]], links[i]) for i, n in enumerate(order)}


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, list[int]], dict[str, tuple[int, int]]]]:
    """The vids, and the cluster and links, of each name of each instance and kind; rows come sorted by these."""
    at, vids = (None, None), {}
    for b in batches:
        for vid, instance, kind, name in zip(*(b.column(c).to_pylist() for c in ("vid", "instance_id", "kind", "name")), strict=True):
            if (instance, kind) != at:
                if vids:
                    yield vids, settled({n: min(v) for n, v in vids.items()}, at[1])
                at, vids = (instance, kind), {}
            if (norm := tokens(name, kind)) and norm not in SPEAKERS:
                vids.setdefault(norm, []).append(vid)
    if vids:
        yield vids, settled({n: min(v) for n, v in vids.items()}, at[1])


def batched(found: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    while got := list(islice(found, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names)


def cluster_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vid, cluster, links."""
    yield from batched(((v, *placed[n]) for vids, placed in groups(batches) for n, vs in vids.items() for v in vs), ["vid", "cluster", "links"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
    for vids, placed in groups(batches):
        members: dict[int, list[int]] = {}
        for n, vs in vids.items():
            members.setdefault(placed[n][0], []).extend(vs)
        for vs in members.values():
            if len(vs) > 1:
                yield from (p for p in combinations(sorted(vs), 2) if p[0] < p[1])


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vid_a < vid_b."""
    yield from batched(_pairs(batches), ["vid_a", "vid_b"])


def placed(entities: DataFrame, run: Callable, schema: str, by_joins: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run over the rows of each instance and kind in a task of their own; by_joins of those that are too many for that."""
    e, key = rows(entities), ["instance_id", "kind"]
    parts = max(entities.sparkSession.sparkContext.defaultParallelism, e.rdd.getNumPartitions())
    wide = written(e.groupBy(*key).count().where(F.col("count") > GROUP).select(*key), "names")
    few = wide.isEmpty()
    together = e if few else e.join(wide, key, "left_anti")
    found = together.repartition(parts, "instance_id").sortWithinPartitions(*key).mapInArrow(run, schema)
    return found if few else found.unionByName(by_joins(spread(e).join(wide, key, "left_semi")))


def clusters(entities: DataFrame) -> DataFrame:
    """vid, cluster, links of each row that may be linked: links counts the other spellings that its own was accepted with."""
    return placed(entities, cluster_rows, "vid bigint, cluster bigint, links bigint", joined)


def paired(named: DataFrame) -> DataFrame:
    c = written(joined(named), "names")
    return c.select(F.col("vid").alias("vid_a"), "cluster").join(c.select(F.col("vid").alias("vid_b"), "cluster"), "cluster").where("vid_a < vid_b").select("vid_a", "vid_b")


def linked(entities: DataFrame) -> DataFrame:
    """vid_a < vid_b of each two rows that mean the same person or organisation."""
    return placed(entities, pair_rows, "vid_a bigint, vid_b bigint", paired)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark.read.parquet(f"{d}/entities.parquet"))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """A row for each entity: its class, and to how many spellings its own was linked."""
    return clusters(spark.read.parquet(f"{d}/entities.parquet"))


QUERIES = {"p5_found": p5_found, "p5_clusters": p5_clusters}
