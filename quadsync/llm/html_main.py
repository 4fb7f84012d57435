"""Operator 3: main text of web pages by a tree-structured graphical model.

Each node of a page's tree (blocks, and leaves that hold text) is main text or
not.  The potential of a parent and a child has two factors, both from the
child's features (tag, names in its attributes and whether it has any, size, share of links): how likely
the child is main text below a parent of either label, and what such a child
says about its parent.  Messages pass from the leaves up and from the root down
(sum-product, exact on a tree) and give each leaf's marginal; leaves of at least
one half are the text.

Training: the nodes of labelled pages.  A leaf has the label of the nearest
labelled element around it, an element has 1 if any leaf below it has.  The
first factor is a logistic regression on nodes below parents of label 1 (below
label 0 all are 0, up to ``LEAK``), the second one of the parent's label on the
child's features, less the parents' shares; as siblings resemble each other it
counts ``EVIDENCE``.  The model is small (``MAX_FEATURES`` weights, twice) and
goes along with the tasks.

Cases: a null or empty html, and a page without main text, give the empty text;
equal rows give equal texts; a null url stays null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadsync.llm.html_labelled import labelled_pages
from quadsync.llm.html_tree import Node, parse
from quadsync.llm.shared import table
from quadsync.session import ship_package

TRAIN_PAGES = 600
MAX_FEATURES = 400
MIN_COUNT = 3
RIDGE = 0.3
LEAK = 1e-4
EVIDENCE = 0.3
ROOT = 3.0


def size_step(n: int) -> int:
    return n.bit_length()


def features(nodes: list[Node], i: int) -> list[str]:
    n = nodes[i]
    links = 0 if not n.chars else 1 + int(3.999 * n.link_chars / n.chars)
    out = [f"links {links}", f"{'leaf' if n.text is not None else 'size'} {size_step(n.chars)}"]
    if n.text is not None:
        end = n.text[-1]
        out += [f"in {nodes[n.parent].tag}", "end " + ("." if end in ".!?:;\"”»" else "," if not end.isalnum() else "a"), *(["mark ©"] if "©" in n.text[:40] else [])]
        return out
    out += [f"tag {n.tag}", f"children {size_step(n.children)}"]
    out += [f"name {w}" for w in n.words]
    if n.words:
        out.append("named")
    return out


def bounded_exp(x: float) -> float:
    return exp(max(-60.0, min(60.0, x)))


class Model:
    def __init__(self, child: dict[str, float], parent: dict[str, float]):
        """Weights of features (and of "" for all nodes): for the node below a parent of label 1, and for its parent."""
        self.child, self.parent = child, parent

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(main) of every node: messages up in reverse page order, then down in page order.
        A message is a log ratio of label 1 to 0."""
        n = len(nodes)
        own, sent, says, q = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        own[0] = ROOT
        child, parent = self.child, self.parent
        for i in range(1, n):
            f = features(nodes, i)
            q[i] = 1 / (1 + bounded_exp(-child[""] - sum(child.get(k, 0.0) for k in f)))
            says[i] = EVIDENCE * (parent[""] + sum(parent.get(k, 0.0) for k in f))
        for i in range(n - 1, 0, -1):
            r = bounded_exp(own[i])
            sent[i] = says[i] + log((1 - q[i] + q[i] * r) / (1 - LEAK + LEAK * r) + 1e-300)
            own[nodes[i].parent] += sent[i]
        full = own[:]
        for i in range(1, n):
            p = nodes[i].parent
            r = bounded_exp(full[p] - sent[i] + says[i])
            full[i] = own[i] + log((LEAK + q[i] * r) / (1 - LEAK + (1 - q[i]) * r))
        return [1 / (1 + bounded_exp(-x)) for x in full]


def node_labels(nodes: list[Node]) -> list[int]:
    """Labels of the nodes of a labelled page."""
    inherited: list[str] = []
    for n in nodes:
        inherited.append(n.label or (inherited[n.parent] if n.parent >= 0 else "0"))
    y = [int(n.text is not None and inherited[i] == "1") for i, n in enumerate(nodes)]
    for i in range(len(nodes) - 1, 0, -1):
        if y[i]:
            y[nodes[i].parent] = 1
    return y


def regression(rows: list[list[str]], ys: list[int], names: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(names) + 1))
    for i, f in enumerate(rows):
        x[i, [names[k] for k in f if k in names]] = 1
    x[:, -1] = 1
    y, beta = np.array(ys, float), np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + RIDGE * np.eye(len(beta)), x.T @ (y - p) - RIDGE * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-3:
            break
    return beta


def train(pages: list[str]) -> Model:
    count: Counter = Counter()
    rows, ys, above = [], [], []
    for html in pages:
        nodes = parse(html)
        y = node_labels(nodes)
        for i, n in enumerate(nodes[1:], 1):
            rows.append(features(nodes, i))
            ys.append(y[i])
            above.append(y[n.parent])
            count.update(rows[-1])
    names = {f: j for j, (f, c) in enumerate(count.most_common(MAX_FEATURES)) if c >= MIN_COUNT}
    below = [i for i, v in enumerate(above) if v]
    child = regression([rows[i] for i in below], [ys[i] for i in below], names)
    parent = regression(rows, above, names)
    parent[-1] -= log(sum(above) / (len(above) - sum(above)))
    columns = {**names, "": len(names)}
    return Model({f: float(child[j]) for f, j in columns.items()}, {f: float(parent[j]) for f, j in columns.items()})


def main_text(html: str, model: Model) -> str:
    nodes = parse(html)
    p = model.marginals(nodes)
    return "\n".join(n.text for n, m in zip(nodes, p, strict=True) if n.text is not None and m >= 0.5)


def extract(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py() or "", model) for h in b.column(2)]
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])
    return run


def extract_main(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars)."""
    ship_package(pages.sparkSession)
    model = model or train(labelled_pages(TRAIN_PAGES))
    return pages.select("page_id", "url", "html").mapInArrow(extract(model), "page_id long, url string, text string, n_chars long")


def op3_html_main(spark, sf_dir):
    return extract_main(table(spark, sf_dir, "pages"))
