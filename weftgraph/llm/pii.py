"""Personal information in free text: spans decoded by a character BiLSTM-CRF, their ends trimmed by exact forms, and replaced by placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charcrf import N_CHARS, PAD, CharCrf, encode
from .pii_samples import KINDS, Maker

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, LAP, HIDDEN, STEPS, BATCH, TRAIN_LEN = 384, 64, 32, 1600, 48, 160
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")

_AT = r"(?:@|%40|&#64;|&#x40;|&commat;|\\u0040|＠|\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s)"
_DOT = r"(?:\.|%2e|&#46;|&period;|\s?[\[({<]\s?(?:dot|punkt|punto|point)\s?[\])}>]\s?|\sdot\s)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_SERVICE = r"(?:git|svn|hg|ssh|no-?reply|do-?not-?reply|postmaster|mailer-daemon|root|admin|support|security|abuse|info|webmaster|hostmaster|builds?|ci|bot|team|help|hello|contact|office|daemon|service|notifications?|list|dev|ops)"
_CAP = r"(?:(?:[OD]['’]|Mc|Mac)?[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß]+(?:-[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß]+)*|[A-ZÀ-ÖØ-Þ](?:['’]?[A-ZÀ-ÖØ-Þ]+)+(?:-[A-ZÀ-ÖØ-Þ]{2,})*)"
_INIT = r"[A-ZÀ-ÖØ-Þ]\."
_OF = r"(?:(?:van|von|de|der|den|del|la|du|VAN|VON|DE|DER|DEN|DEL|LA|DU)[ ]){0,2}"
_NO = r"\d{1,4}(?:\s?[a-d](?![\w]))?"
_STREET = r"[^\W\d_][\w'’-]*\.?"
_WAY = r"(?:street|st|road|rd|lane|ln|close|avenue|ave|terrace|drive|dr|court|ct|place|way|square|crescent|row|gardens?|hill|mews|walk|grove|boulevard|blvd)\b\.?"

EXACT = {
    "email": [re.compile(rf"(?<![\w.+-])(?!{_SERVICE}(?![\w.+-]))[a-z0-9][\w.+'-]*{_AT}{_LABEL}(?:{_DOT}{_LABEL})+(?![\w])(?!:\w+/)", re.I)],
    "phone": [re.compile(p) for p in (
        r"(?<![\w.+/-])(?:\+|00)\d{1,3}(?:[ .-]?\(0\)[ ]?|[ .-])?\d{1,4}(?:[ .-]?\d{2,4}){2,5}(?:\s?(?:ext\.?|x)\s?\d{1,5})?(?![\w-])",
        r"(?<![\w.+/-])\(\d{3}\)[ ]?\d{3}[-. ]\d{4}(?:\s?(?:ext\.?|x)\s?\d{1,5})?(?![\w-])",
        r"(?<![\w.+/-])\d{3}([-. ])\d{3}\1\d{4}(?:\s?(?:ext\.?|x)\s?\d{1,5})?(?![\w-])",
        r"(?<![\w.+/-])0\d{1,4}[ /]\d{3,4}[ ]?\d{3,6}(?![\w-])",
        r"(?<![\w.+/-])\(0\d{1,4}\)[ ]?\d{3,4}[ ]?\d{3,6}(?![\w-])",
        r"(?<![\w.+/-])0\d(?:[ .]\d{2}){4}(?![\w-])",
    )],
    "identity": [re.compile(p) for p in (
        r"(?<![\w-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])",
        r"(?<![\w.-])\d{9}(?![\w-])",
        r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])",
        r"(?<![\w-])\d{8}-?[A-HJ-NP-TV-Z](?![\w-])",
        r"(?<![\w-])[A-Z]{1,2}\d{7}(?![\w-])",
    )],
    "address": [re.compile(p, re.I) for p in (
        rf"(?<![\w.-]){_NO}\s(?:{_STREET}\s){{1,3}}?{_WAY}(?![\w])",
        rf"(?<![\w.-])\d{{1,4}}[a-d]?(?:\s(?:bis|ter|quater))?,?\s(?:rue|chemin|avenue|place|boulevard|allée|impasse|quai|route)\s(?:(?:du|de la|de l'|des|de|d')\s?)?[^\W\d_][\w'’-]*",
        rf"(?<![\w-])[^\W\d_][\w'’-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer)\s\d{{1,4}}(?:\s?[a-d](?!\w))?(?![\w])",
        rf"(?<![\w-])(?:calle|plaza|avenida|paseo|camino|ronda|c/)\s(?:(?:de la|de los|del|de)\s)?[^\W\d_][\w'’-]*,?\s\d{{1,4}}(?:\s?[a-d](?!\w))?(?![\w])",
    )],
    "name": [re.compile(p) for p in (
        rf"(?<![\w@/.-])(?:{_CAP}|{_INIT})(?:[ ]{_INIT}){{0,2}}[ ]{_OF}{_CAP}(?![\w(/]|['’.]\w)",
        rf"(?<![\w@/.-]){_OF}{_CAP},[ ](?:{_CAP}|{_INIT})(?:[ ]{_INIT}){{0,2}}(?![\w(/]|['’]\w)",
    )],
}


def inputs(text: str, given: frozenset, family: frozenset) -> np.ndarray:
    """Character classes, shifted where the character's word is a listed name part."""
    x = encode(text)
    for m in _WORD.finditer(text):
        w = m.group().casefold()
        flag = (w in given) + 2 * (w in family)
        if flag:
            x[m.start() : m.end()] += N_CHARS * flag
    return x


def training_windows(seed: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``steps`` batches of BATCH labelled windows, the bound of the training set: invented lines with invented name parts, half of them on an invented list."""
    make = Maker([], [], seed)
    index = {t: i for i, t in enumerate(TAGS)}
    g, f = frozenset(map(str.casefold, make.given)), frozenset(map(str.casefold, make.family))
    for _ in range(steps):
        xs, ys = [], []
        for _ in range(BATCH):
            text, tags = make.text(TRAIN_LEN)
            x, y = inputs(text, g, f), np.array([index[t] for t in tags])
            if make.r.random() < 0.2:  # texts that end inside a window
                end = make.r.randint(10, TRAIN_LEN)
                x[end:], y[end:] = PAD, 0
            xs.append(x)
            ys.append(y)
        yield np.array(xs), np.array(ys)


def train(steps: int = STEPS, seed: int = 11) -> CharCrf:
    model = CharCrf(4 * N_CHARS, len(TAGS), HIDDEN, seed)
    model.fit(training_windows(seed, steps), rate=0.02, steps=steps)
    return model


MODEL = Path(__file__).with_name("pii_model.npz")


def save(model: CharCrf, path: Path = MODEL) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in model.p.items()})


@lru_cache(maxsize=1)
def stored() -> CharCrf:
    """The tagger that ``python -m weftgraph.llm.pii`` trained and stored."""
    model = CharCrf(4 * N_CHARS, len(TAGS), HIDDEN)
    with np.load(MODEL) as f:
        model.p = {k: f[k].astype(np.float32) for k in f.files}
    return model


def tag_texts(model: CharCrf, xs: list[np.ndarray], batch: int = 512) -> list[np.ndarray]:
    """A tag for every character of every text: windows overlap by LAP, and of two windows the one in whose inside a character lies further from the edge decides."""
    out = [np.zeros(len(x), np.int8) for x in xs]
    spans = []
    for i, x in enumerate(xs):
        for a in range(0, max(1, len(x) - LAP), WINDOW - LAP):
            spans.append((i, a, min(a + WINDOW, len(x))))
    spans.sort(key=lambda s: s[2] - s[1])
    for k in range(0, len(spans), batch):
        part = spans[k : k + batch]
        width = max(b - a for _, a, b in part)
        if not width:
            continue
        w = np.full((len(part), width), PAD, np.int64)
        for j, (i, a, b) in enumerate(part):
            w[j, : b - a] = xs[i][a:b]
        tags = model.decode(w)
        for j, (i, a, b) in enumerate(part):
            lo = a if a == 0 else a + LAP // 2
            hi = b if b == len(xs[i]) else b - LAP // 2
            out[i][lo:hi] = tags[j, lo - a : hi - a]
    return out


SLIP = 4  # characters by which a form may begin before or after the decoded span
LEXICON = 1_000_000  # name parts that may be given


def decoded(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the spans that a tag sequence names: a beginning and what goes on with its kind; a span without a beginning begins at its first character."""
    kind = (tags.astype(np.int16) + 1) // 2
    cuts = np.flatnonzero((np.diff(kind, prepend=0) != 0) | ((tags % 2 == 1) & (tags > 0)))
    ends = [*cuts[1:].tolist(), len(tags)]
    return [(a, b, KINDS[kind[a] - 1]) for a, b in zip(cuts.tolist(), ends) if kind[a]]


def trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The ends of a decoded span by the exact form of its kind that begins within SLIP characters of it and has the most in common with it; None if there is none that covers half of it."""
    best, found = 0, None
    for a in range(max(0, start - SLIP), min(end, start + SLIP + 1)):
        for p in EXACT[kind]:
            m = p.match(text, a)
            if m:
                both = min(end, m.end()) - max(start, a)
                score = 2 * both - (m.end() - a)
                if 2 * both >= end - start and (found is None or score > best):
                    best, found = score, (a, m.end())
    return found


def check_spans(text: str, tags: np.ndarray) -> list[tuple[int, int, str]]:
    """The decoded spans, their ends trimmed by the exact form of their kind, in order and without overlaps (of two the earlier stays). Spans of no form are dropped; a form alone is never taken."""
    out: list[tuple[int, int, str]] = []
    for s, e, k in decoded(tags):
        found = trimmed(text, s, e, k)
        if found and not (out and found[0] < out[-1][1]):
            out.append((*found, k))
    return out


def find_pii(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: CharCrf | None = None) -> DataFrame:
    """(id, kind, start_pos, end_pos, value): one row per occurrence, positions in characters from 0.

    ``lexicon`` (name_part, name_role) is a list read by the driver, at most LEXICON parts (more are an error); NULL parts are passed over and it may be empty. The tagger is the
    stored one unless another is given; it was trained on invented lines, never on ``docs``, so it is the same at every size. Every text is tagged over its whole length;
    the decoded spans are the occurrences, and the exact form of their kind trims their ends. NULL and empty texts give no rows; repeated rows give repeated results.
    """
    parts = lexicon.select("name_part", "name_role").where("name_part is not null").distinct().limit(LEXICON + 1).collect()
    if len(parts) > LEXICON:
        raise ValueError(f"at most {LEXICON} name parts")
    spark = docs.sparkSession
    g = frozenset(r[0].casefold() for r in parts if r[1] != "family")
    f = frozenset(r[0].casefold() for r in parts if r[1] == "family")
    shared = spark.sparkContext.broadcast((model or stored(), g, f))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    kind = dict(base.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, g, f = shared.value
        for frame in frames:
            rows = []
            for lo in range(0, len(frame), 1000):
                part = frame.iloc[lo : lo + 1000]
                tags = tag_texts(model, [inputs(t, g, f) for t in part["text"]])
                for i, t, tag in zip(part["id"], part["text"], tags):
                    rows.extend((i, k, s, e, t[s:e]) for s, e, k in check_spans(t, tag))
            yield pd.DataFrame(rows, columns=["id", "kind", "start_pos", "end_pos", "value"])

    return base.mapInPandas(run, f"id {kind}, kind string, start_pos int, end_pos int, value string").withColumnRenamed("id", id_col)


PLACEHOLDERS = {"email": "<EMAIL>", "phone": "<PHONE>", "identity": "<ID>", "address": "<ADDRESS>", "name": "<NAME>"}


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, redacted, n_replaced): the text with each occurrence replaced by its kind's placeholder, all else unchanged. ``id_col`` must be unique in ``docs``; texts without occurrences and NULL texts come out as they are."""
    per = found.select(F.col(id_col).alias("__id"), F.struct("start_pos", "end_pos", "kind").alias("s")).groupBy("__id").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    base = docs.select(id_col, F.col(text_col).alias("__t")).join(per, F.col(id_col) == F.col("__id"), "left")
    names = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    text = F.aggregate(
        F.col("spans"), start,
        lambda acc, s: F.struct(F.concat(acc["done"], F.substring(F.col("__t"), acc["at"] + 1, s["start_pos"] - acc["at"]), names[s["kind"]]).alias("done"), s["end_pos"].alias("at")),
        lambda acc: F.concat(acc["done"], F.substring(F.col("__t"), acc["at"] + 1, F.length("__t"))),
    )
    return base.select(id_col, F.when(F.col("spans").isNull(), F.col("__t")).otherwise(text).alias("redacted"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_replaced"))


if __name__ == "__main__":
    save(train())
