"""Copies hidden by formatting, found by hashing records bottom-up.

An ad is a nested record: its body is an ordered leaf, and the closing lines of
the form ``label: value`` are the children of an unordered node. Leaves are
normalised (compatibility form, case folded, letters and digits kept), the
digests of the closing lines are sorted before they are hashed, and the root
digest covers company, body and node. Ads of one company with one root are
candidates; the whole normalised structure is compared before they are merged,
because it is part of the grouping key beside the digest.

Formatting may also remove the line breaks or colons, so that the unordered node
can't be seen. Such a flat record is compared with the structured records that
hold the same letters and digits in any order (a sum digest over characters): it
belongs to one if its sequence is that body followed by those closing lines in
some order, each used once. Where the body ends may also be seen differently, as
formatting may join or part its last lines: two structures of the same letters are
one class if the sequence of either is an arrangement of the other.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import filled
from tasklattice.plans.components import components
from tasklattice.plans.lineage import cut
from tasklattice.plans.skew import join_groups_back

_NOT_ALNUM = re.compile(r"[\W_]+")
_COLON = re.compile("[:：]")


def leaf(text: str) -> str:
    """Letters and digits of ``text`` in their order, case folded."""
    return _NOT_ALNUM.sub("", unicodedata.normalize("NFKC", text).casefold())


def is_closing(line: str) -> bool:
    """A line of the form ``label: value``, however long: letters before the first
    colon, letters or digits after it."""
    label, *value = _COLON.split(line, maxsplit=1)
    return bool(value) and any(ch.isalpha() for ch in label) and bool(leaf(value[0]))


def structure(text: str) -> tuple[str, list[str]]:
    """The normalised body and the sorted, normalised closing lines."""
    lines = text.splitlines()
    closing: list[str] = []
    while lines:
        last = lines[-1]
        if not (value := leaf(last)):
            lines.pop()
        elif is_closing(last):
            closing.append(value)
            lines.pop()
        else:
            break
    if len(closing) < 2:  # one line alone has one order
        return leaf(text), []
    return leaf("\n".join(lines)), sorted(closing)


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\x00".join(parts), digest_size=16).digest()


def root_digest(body: str, closing: list[str]) -> bytes:
    return digest(digest(body.encode()), digest(*sorted(digest(c.encode()) for c in closing)))


def bag_digest(sequence: str) -> bytes:
    """Digest of the characters and how often each occurs, whatever their order."""
    return digest(repr(sorted(Counter(sequence).items())).encode())


def arranged(sequence: str, body: str, closing: list[str]) -> bool:
    """Whether ``sequence`` is ``body`` and then all of ``closing`` in some order."""
    if not sequence.startswith(body):
        return False
    seen: set[tuple[int, tuple[int, ...]]] = set()
    kinds = sorted(set(closing))
    stack = [(len(body), tuple(closing.count(k) for k in kinds))]
    while stack:
        state = stack.pop()
        if state in seen:
            continue
        seen.add(state)
        at, left = state
        if at == len(sequence) and not any(left):
            return True
        for i, kind in enumerate(kinds):
            if left[i] and sequence.startswith(kind, at):
                stack.append((at + len(kind), (*left[:i], left[i] - 1, *left[i + 1 :])))
    return False


_SEP = "\x1f"


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("sequence", "form", "root", "bag")}
        for text in b["content_clean"]:
            body, closing = structure(text)
            sequence = leaf(text)
            out["sequence"].append(sequence)
            out["form"].append(_SEP.join([body, *closing]) if closing else None)
            out["root"].append(root_digest(body, closing))
            out["bag"].append(bag_digest(sequence))
        yield pd.DataFrame({"uid": b["uid"], "company_id": b["company_id"], **out})


def _fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = [arranged(s, *(lambda body, *c: (body, list(c)))(*f.split(_SEP))) for s, f in zip(b["sequence"], b["form"], strict=True)]
        yield b.loc[ok, ["company_id", "seq_id", "class_root"]]


def _same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = []
        for f, g in zip(b["form"], b["form_b"], strict=True):
            (x, *c), (y, *d) = f.split(_SEP), g.split(_SEP)
            ok.append(arranged("".join([y, *d]), x, c) or arranged("".join([x, *c]), y, d))
        yield b.loc[ok, ["a", "b"]]


def structural_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` has uid, company_id and content_clean; other columns are ignored.

    Returns the members (uid, company_id, class_root) and the classes
    (company_id, class_root, representative, copies), where the representative is
    the smallest uid by code points. Rows whose company_id is null or whose text
    is null, blank or without any letter and digit are in neither. A uid that
    occurs again with the same text counts once. An empty input gives empty
    results.

    Plan: one pass of Arrow batches makes the digests and is written once. The
    sequences are grouped with map-side combination, so copies of one text collapse
    before the shuffle, however many rows they are. What is left, one row per
    different sequence, is grouped by root and joined with the structures of its
    bag: different structures of one company made of the very same letters, which
    are few however many copies they have.
    """
    source = rows.filter(F.col("company_id").isNotNull() & filled("content_clean")).select("uid", F.col("company_id").cast("bigint").alias("company_id"), "content_clean")
    hashed = source.mapInPandas(_hashed, "uid string, company_id bigint, sequence string, form string, root binary, bag binary").filter(F.col("sequence") != "")
    # The digest leads the key and the whole sequence confirms it.
    hashed = cut(hashed.withColumn("seq_id", F.sha2("sequence", 256)))
    sequences = cut(
        hashed.groupBy("company_id", "seq_id", "sequence", "bag").agg(
            F.max(F.when(F.col("form").isNotNull(), F.struct(F.length("form").alias("n"), "form", "root"))).alias("best"),
            F.max("root").alias("flat_root"),
        )
    )
    shaped = sequences.filter(F.col("best").isNotNull()).select("company_id", "bag", "seq_id", F.col("best.form").alias("form"), F.col("best.root").alias("root"))
    # One row per root and structure: the structure is compared as part of the key.
    forms = shaped.groupBy("company_id", "bag", "root", "form").agg(F.count("*").alias("n_seq"))
    flat = sequences.filter(F.col("best").isNull())
    fitted = (
        flat.select("company_id", "bag", "seq_id", "sequence")
        .join(forms.select("company_id", "bag", "form", F.col("root").alias("class_root")), ["company_id", "bag"])
        .select("company_id", "seq_id", "sequence", "form", "class_root")
        .mapInPandas(_fits, "company_id bigint, seq_id string, class_root binary")
        .groupBy("company_id", "seq_id")
        .agg(F.min("class_root").alias("class_root"))
    )
    roots = shaped.select("company_id", "seq_id", F.col("root").alias("class_root")).unionByName(
        flat.join(fitted, ["company_id", "seq_id"], "left").select("company_id", "seq_id", F.coalesce("class_root", F.unhex(F.substring("seq_id", 1, 32))).alias("class_root"))
    )
    other = forms.select("company_id", "bag", F.col("root").alias("b"), F.col("form").alias("form_b"))
    meeting = forms.select("company_id", "bag", F.col("root").alias("a"), "form").join(other, ["company_id", "bag"]).filter(F.col("a") < F.col("b"))
    links = cut(meeting.select("form", "form_b", "a", "b").mapInPandas(_same, "a binary, b binary"))
    if not links.isEmpty():
        joined = components(links, "a", "b").select(F.col("id").alias("class_root"), "component")
        roots = roots.join(joined, "class_root", "left").select("company_id", "seq_id", F.coalesce("component", "class_root").alias("class_root"))
    ids = hashed.select("uid", "company_id", "seq_id").distinct()
    per_sequence = roots.join(ids.groupBy("company_id", "seq_id").agg(F.count("*").alias("n_rows")), ["company_id", "seq_id"])
    members = join_groups_back(ids, per_sequence, ["company_id", "seq_id"], "n_rows").select("uid", "company_id", "class_root")
    classes = members.groupBy("company_id", "class_root").agg(F.min("uid").alias("representative"), F.countDistinct("uid").alias("copies"))
    return members, classes


def copies_of(rows: DataFrame) -> DataFrame:
    """Each ad that is a copy, with the smallest uid of its class:
    (uid_a, uid_b), all different."""
    members, classes = structural_classes(rows)
    joined = join_groups_back(members, classes.filter(F.col("copies") > 1), ["company_id", "class_root"], "copies")
    return joined.filter(F.col("uid") != F.col("representative")).select(F.col("representative").alias("uid_a"), F.col("uid").alias("uid_b")).distinct()


def collapsed(rows: DataFrame) -> DataFrame:
    """One row per class: (company_id, uid, copies)."""
    _, classes = structural_classes(rows)
    return classes.select("company_id", F.col("representative").alias("uid"), "copies")
