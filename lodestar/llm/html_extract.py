"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Method. A page is cut into leaf blocks (dom_blocks). A block's features are the tags and the words of class, id and role of all elements
above it, the nearest of them that say something, its own tag, whether it is in a container of content or the page has one elsewhere, and its
text: length, share of links, punctuation, place in the page. The field (crf) is trained on
labelled pages (labelled_pages; invented from a seed, since no labelled pages come with the data) and labels a page's
blocks together by Viterbi. Blocks labelled as main text are joined.

Scale. A page is read by the task that scans it; nothing is shuffled. Training needs some seconds on the driver and gives a table
of a few hundred features, which goes along with the task.

Defined cases. Null and empty html, and pages without main text, give an empty text. Plain wrappers, deep nesting and long lists of class
names change nothing; a page without any container of content gives its running text. A page that breaks off inside a
tag, comment or script ends there. Null page_id and url are kept; repeated rows come out as often; an empty table gives
an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import crf
from .common import read_table
from .dom_blocks import Block, Node, blocks
from .labelled_pages import NAMES, page

PAGES, SEED = 1200, 1000

_ENDS = frozenset(".!?…:;\"'”»")
#: Elements that say nothing of what a block within them is.
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split())
_PLAIN = _INLINE | frozenset("html body div center tbody thead tfoot".split())
#: Elements that do, as do the names of labelled_pages.NAMES.
_MARKS = frozenset("article aside button dialog fieldset footer form header main menu nav select".split())
_NAMED = frozenset(w for names in NAMES.values() for n in names for w in n.split("-"))
_CONTENT = frozenset(w for n in NAMES["content"] for w in n.split("-"))


#: Features of a block's text and place in the page.
_OF_TEXT = frozenset({"words", "links", "ends", "open", "third", "copyright", "first", "last"})


@dataclass(slots=True)
class Place:
    """What an element and all above it say of the blocks within: features, the nearest mark, the nearest element that isn't inline,
    whether it is in a container of content."""

    features: frozenset[str]
    near: tuple[str, ...]
    own: str
    content: bool
    all: tuple[str, ...] = ()


ROOT = Place(frozenset(), ("near:none",), "none", False)


def _place(node: Node | None, known: Collection[str] | None) -> Place:
    """Of an element, from that of the one above; an element that adds nothing shares its set, so deep nesting costs no more than its depth.
    known: the features that count."""
    missing = []
    while node is not None and node.place is None:
        missing.append(node)
        node = node.above
    place = ROOT if node is None else node.place
    for node in reversed(missing):
        new = {f"name:{x}" for x in node.names}
        if node.tag not in _PLAIN:
            new.add(f"in:{node.tag}")
        if known is not None:
            new = {f for f in new if f in known}
        near = [f"near:{x}" for x in node.names if x in _NAMED]
        if node.tag in _MARKS:
            near.append(f"near:{node.tag}")
        content = place.content or node.tag in ("article", "main") or not _CONTENT.isdisjoint(node.names)
        features = place.features if new <= place.features else place.features | new
        node.place = place = Place(features, tuple(near) or place.near, place.own if node.tag in _INLINE else node.tag, content)
    if not place.all:
        place.all = (*sorted(place.features), *place.near, f"own:{place.own}")
    return place


def features(seq: list[Block], known: Collection[str] | None = None) -> list[list[str]]:
    out, n = [], len(seq)
    places = [_place(b.node, known) for b in seq]
    any_content = any(p.content for p in places)
    for i, (b, p) in enumerate(zip(seq, places, strict=True)):
        text = b.text
        where = ("in" if p.content else "out") if any_content else "none"
        words, links = min((text.count(" ") + 1).bit_length(), 8), 4 * b.linked // max(1, len(text))
        f = [
            "bias",
            *p.all,
            f"content:{where}",
            f"words:{words}",
            f"links:{links}",
            f"links:{links}:{where}",
            f"links:{links}:{p.own}",
            f"own:{p.own}:{where}",
            f"words:{words}:{where}",
            "ends" if text[-1] in _ENDS else "open",
            f"third:{3 * i // n}:{where}",
        ]
        if text[0] == "©":
            f.append("copyright")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        out.append(f)
    return out


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED) -> crf.Chain:
    data, rng = [], np.random.default_rng(seed)
    for k in range(pages):
        markup, labels = page(seed + k)
        seq = blocks(markup)
        if len(seq) != len(labels):
            raise AssertionError(f"training page {seed + k} has {len(labels)} labels for {len(seq)} blocks")
        found = features(seq)
        if rng.random() < 0.3:  # so that elements and names are learned though the text would tell
            found = [[f for f in fs if f.partition(":")[0] not in _OF_TEXT] for fs in found]
        data.append((found, labels))
    return crf.train(data)


def main_text(markup: str | None, chain: crf.Chain) -> str:
    seq = blocks(markup)
    return "\n\n".join(b.text for b, y in zip(seq, chain.decode(features(seq, chain.index)), strict=True) if y)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    chain = trained()

    def tasks(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = [main_text(m, chain) for m in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(tasks, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
