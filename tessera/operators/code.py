"""Code similarity: language, renamed tokens, sequence ratio, best block pair."""

from __future__ import annotations

import ast
import difflib
import warnings
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.text import let
from tessera.operators import products, similarity
from tessera.scratch import Scratch

# Constructs that point to a language, in the order that breaks ties.
LANGUAGE_MARKS = {
    "python": r"\bdef \w+\(|\bimport \w+|\bself\.|\belif\b|:\s*(?:\n|$)|\bNone\b",
    "c": r"#include\s*<\w+\.h>|\bprintf\(|\bscanf\(|\bmalloc\(|\bstruct \w+",
    "cpp": r"\bstd::|\bcout\s*<<|\bcin\s*>>|\busing namespace\b|\btemplate\s*<|#include\s*<\w+>",
    "java": r"\bpublic class\b|\bSystem\.out\b|\bpublic static\b|\bString\[\]|\bnew \w+\(",
}
# Reserved words of the four languages, which renaming leaves alone.
RESERVED = (
    "and as assert auto bool break case catch char class const continue cout cin def default delete do double elif else "
    "enum except extends false final finally float for from global if implements import in include int interface is "
    "lambda long main namespace new none not null or pass print printf private protected public raise return scanf "
    "self short signed sizeof static std string struct super switch template this throw throws true try typedef "
    "union unsigned using virtual void volatile while with yield"
).split()
_LEX = r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[A-Za-z_]\w*|\d+(?:\.\d+)?|[-+*/%=<>!&|^~?:;,.(){}\[\]#])"""
_COMMENT = r"(?s)/\*.*?\*/|(?m)//[^\n]*|#(?!include|define|ifdef|ifndef|pragma)[^\n]*"
MAX_TOKENS = 10_000
SHORT = 1000  #: tokens of two sides, up to which their ratio is remembered


def language(block: Column) -> Column:
    """The language with the most of its marks; the first on ties. Stands in for parsing with each grammar."""
    marks = [F.struct(F.regexp_count(block, F.lit(p)).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, p) in enumerate(LANGUAGE_MARKS.items())]
    return F.array_max(F.array(*marks))["name"]


def renamed_tokens(block: Column) -> Column:
    """Tokens of a block with identifiers replaced by var0, var1, ... in order of first appearance.

    Comments go; literals under 50 characters, reserved words and marks stay.
    """
    tokens = F.filter(F.regexp_extract_all(F.regexp_replace(F.coalesce(block, F.lit("")), _COMMENT, " "), F.lit(_LEX), F.lit(1)), lambda t: F.length(t) < 50)
    is_name = lambda t: t.rlike(r"^[A-Za-z_]") & ~F.lower(t).isin(RESERVED)
    both = lambda ts: F.struct(ts.alias("tokens"), F.array_distinct(F.filter(ts, is_name)).alias("names"))
    rename = lambda s: F.transform(s["tokens"], lambda t: F.when(is_name(t), F.concat(F.lit("var"), (F.array_position(s["names"], t) - 1).cast("string"))).otherwise(t))
    return let(let(tokens, both), rename)


def _walk(root: ast.AST) -> list[str]:
    """Kinds of the nodes in source order, with names numbered by first appearance and short constants as they are."""
    names: dict[str, str] = {}
    out, left = [], [root]
    while left:
        node = left.pop()
        out.append(type(node).__name__)
        for key in ("id", "arg", "name", "attr"):
            own = getattr(node, key, None)
            if isinstance(own, str):
                out.append(names.setdefault(own, f"var{len(names)}"))
        if isinstance(node, ast.Constant) and len(shown := repr(node.value)) < 50:
            out.append(shown)
        left += [n for n in reversed([*ast.iter_child_nodes(node)]) if not isinstance(n, (ast.expr_context, ast.Load))]
    return out


def syntax_tokens(source: str, *, ordered: bool = True) -> list[str] | None:
    """Tokens of a Python program's syntax tree; None if it is not one.

    ordered: False sorts the definitions and statements at the top, each with names of its own, so that moving functions about changes nothing.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return _walk(tree) if ordered else ["Module", *(t for part in sorted(_walk(n) for n in tree.body) for t in part)]


def code_tokens(rows: DataFrame, block: str, name: str, *, mode: str = "lexer", ordered: bool = True) -> DataFrame:
    """Adds a column of a block's tokens: ``lexer`` those of ``renamed_tokens``; ``ast`` those of ``syntax_tokens`` for blocks whose language is Python
    and that parse, the lexer's for all others. Null blocks have no tokens. Only Python blocks reach Python."""
    if mode == "lexer":
        return rows.withColumn(name, renamed_tokens(F.col(block)))
    if mode != "ast":
        raise ValueError(f"no such mode: {mode}")

    @F.pandas_udf("array<string>")
    def parsed(source: pd.Series) -> pd.Series:
        return source.map(lambda t: syntax_tokens(t, ordered=ordered), na_action="ignore")

    python = F.col(block).isNotNull() & (language(F.col(block)) == "python")
    mine = rows.where(python).withColumn("_tree", parsed(F.col(block))).withColumn(name, F.coalesce("_tree", renamed_tokens(F.col(block)))).drop("_tree")
    return mine.unionByName(rows.where(~python | python.isNull()).withColumn(name, renamed_tokens(F.col(block))))


def _ratio(x: list | None, y: list | None) -> float:
    x, y = (x or [])[:MAX_TOKENS], (y or [])[:MAX_TOKENS]
    if x == y:
        return 1.0
    return difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0


def sequence_ratio(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds a column: the matching-block ratio of two token arrays over their first 10 000 tokens; both empty 1, one empty 0.

    The arrays are computed on the rows first; Python sees them, and no expression that makes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            ratio = pa.array([_ratio(p, q) for p, q in zip(x, y)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ratio], names=[*batch.schema.names, name])

    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])
    return rows.mapInArrow(run, schema)


def block_rows(docs: DataFrame, *, mode: str = "lexer") -> DataFrame:
    """(batch, doc, tokens) of every block of (batch, doc, blocks) that has tokens; modes as in ``code_tokens``."""
    rows = code_tokens(docs.select("batch", "doc", F.explode("blocks").alias("block")), "block", "tokens", mode=mode).select("batch", "doc", "tokens")
    return rows.where(F.size("tokens") > 0)


def best_ratio(left: list[list[str]], right: list[list[str]]) -> tuple[float, int, int]:
    """The best ratio of two blocks, how many ratios were computed, and how many there are.

    Twice the tokens that two blocks have in common, in any order, over their lengths is no less than their ratio; blocks are tried
    by falling bound until none that is left can beat the best.
    """
    left, right = ([x[:MAX_TOKENS] for x in side] for side in (left, right))
    counts = [[Counter(x) for x in side] for side in (left, right)]
    bounds = [(2 * (p & q).total() / (len(x) + len(y)), i, j) for i, (x, p) in enumerate(zip(left, counts[0])) for j, (y, q) in enumerate(zip(right, counts[1]))]
    best, tried = 0.0, 0
    for bound, i, j in sorted(bounds, key=lambda b: (-b[0], b[1:])):
        if bound <= best:
            break
        best, tried = max(best, _ratio(left[i], right[j])), tried + 1
    return best, tried, len(bounds)


@lru_cache(4096)
def _of_pattern(x: tuple, y: tuple, same: tuple) -> tuple[float, int, int]:
    """``best_ratio`` of two sides whose tokens are numbered by first appearance, ``same`` being the other side's number of each of the first's: it depends on no more."""
    back = {j: i for i, j in enumerate(same) if j is not None}
    return best_ratio([list(b) for b in x], [[back.get(t, ~t) for t in b] for b in y])


class Sides:
    """The blocks of a cell's documents, one after the other. Documents that differ by tokens only that no other one has are a class: they score alike with each document.

    So a score is computed once for each two classes. Equal blocks count once, and their order is that of their tokens.
    """

    def __init__(self, blocks: pa.ListArray):
        inner = blocks.flatten()
        coded = inner.flatten().dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int32)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank), dtype=np.int32)
        self.tokens = rank[coded.indices.to_numpy()] if len(rank) else np.empty(0, np.int32)
        ends = lambda c: np.concatenate([[0], np.cumsum(pc.fill_null(c.value_lengths(), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.block, self.doc = ends(inner), ends(blocks)
        line = np.repeat(np.arange(len(blocks)), np.diff(self.block[self.doc]))
        shared = np.bincount(np.unique(line * max(len(rank), 1) + self.tokens) % max(len(rank), 1), minlength=len(rank)) > 1
        known: dict[tuple, int] = {}
        self.kind = np.empty(len(blocks), np.int64)  # the class
        for i in range(len(blocks)):
            own: dict[int, int] = {}
            self.kind[i] = known.setdefault(tuple(tuple(t if shared[t] else ~own.setdefault(t, len(own)) for t in b) for b in self.of(i)), len(known))
        self.found: dict[int, tuple[float, int, int]] = {}

    def of(self, i: int) -> list[list[int]]:
        """A document's blocks; tokens are numbered by their order."""
        return sorted(self.tokens[lo : min(hi, lo + MAX_TOKENS)].tolist() for lo, hi in zip(self.block[self.doc[i] : self.doc[i + 1]], self.block[self.doc[i] + 1 : self.doc[i + 1] + 1]))

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ratio of two blocks, how many were tried, and how many there are, of pairs of documents by number."""
        if not len(a):
            return np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        names, at, back = np.unique(self.kind[a] * len(self.kind) + self.kind[b], return_index=True, return_inverse=True)
        for name, k in zip(names.tolist(), at):
            if name not in self.found:
                self.found[name] = _of_blocks(self.of(a[k]), self.of(b[k]))
        found = [self.found[name] for name in names.tolist()]
        return tuple(np.array([f[i] for f in found], kind)[back] for i, kind in enumerate((np.float64, np.int64, np.int64)))


def _of_blocks(x: list[list[int]], y: list[list[int]]) -> tuple[float, int, int]:
    if sum(map(len, x)) + sum(map(len, y)) > SHORT:
        return best_ratio(x, y)
    nx: dict[int, int] = {}
    ny: dict[int, int] = {}
    px, py = (tuple(tuple(names.setdefault(t, len(names)) for t in b) for b in side) for side, names in ((x, nx), (y, ny)))
    return _of_pattern(px, py, tuple(map(ny.get, nx)))


def _cell_scores(every: bool):
    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        sides = Sides(rows["blocks"].combine_chunks())
        doc, order = np.unique(rows["doc"].to_numpy(), return_index=True)
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        there = np.isin(a, doc) & np.isin(b, doc)
        x, y = (order[np.searchsorted(doc, side[there])] for side in (a, b))
        kept = pairs.select(["batch", "a", "b"])
        if not every:
            kept = kept.filter(pa.array(there))
            there = there[there]
        for name, own in zip(("code_score", "n_tried", "n_ratios"), sides.scores(x, y)):
            value = np.zeros(len(there), own.dtype)
            value[there] = own
            kept = kept.append_column(name, pa.array(value))
        return kept

    return run


def block_scores(pairs: DataFrame, blocks: DataFrame, *, every: bool = False) -> DataFrame:
    """(batch, a, b, code_score, n_tried, n_ratios) of the pairs whose sides both have blocks, or of every pair: the best ratio of two blocks, and what it took.

    Equal blocks of a document count once. Blocks go to the cells of pairs that need them, once each, pairs of equal classes (``Sides``)
    are scored once for a cell, and those that differ by the names of their tokens only once for a worker, up to 1000 tokens.
    """
    side = blocks.groupBy("batch", "doc").agg(F.collect_set("tokens").alias("blocks"))
    cell = products.cells(pairs.select("batch", "a", "b"), blocks.select("batch", "doc").distinct())
    need = cell.select("batch", "ca", "cb", F.explode(F.array("a", "b")).alias("doc")).distinct()
    rows = need.join(side, ["batch", "doc"]).select(F.col("batch").alias("own"), F.col("ca").alias("x"), F.col("cb").alias("y"), "doc", "blocks")
    kinds = dict(pairs.dtypes)
    found = cell.groupBy("batch", "ca", "cb").cogroup(rows.groupBy("own", "x", "y"))
    return found.applyInArrow(_cell_scores(every), f"batch {kinds['batch']}, a {kinds['a']}, b {kinds['b']}, code_score double, n_tried long, n_ratios long")


def candidate_scores(blocks: DataFrame) -> DataFrame:
    """(batch, a, b, code_score) of the pairs whose code shares a signature band (``similarity.lsh_candidates``), scored where they are found: none is shuffled."""
    blocks = Scratch(blocks.sparkSession, "blocks").save(blocks)
    each, same = similarity._banded(similarity.minhash_signatures(token_grams(blocks), k=1), 32, 4, None)
    side = blocks.groupBy("batch", "doc").agg(F.collect_set("tokens").alias("code"))

    def of(rows: pa.Table):
        sides = Sides(rows["code"].combine_chunks())
        return lambda x, y: {"code_score": sides.scores(x, y)[0]}

    found = similarity.in_bands(each.join(side, ["batch", "doc"]), of, ", code_score double")
    return found.unionByName(block_scores(same, blocks, every=True).select("batch", "a", "b", "code_score"))


def shared_scores(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(batch, n, n_both, n_scored, n_equal, n_tried, n_ratios): how many pairs of (batch, doc, text) share sentences; of how many both sides have blocks, of these have a code score above 0, and one of 0.999;
    and the sums of ``block_scores``. Pairs are found and scored in tiles, so none is a row."""
    side = blocks.groupBy("batch", "doc").agg(F.collect_set("tokens").alias("code"))
    rows = similarity.sentence_vectors(docs).join(side, ["batch", "doc"], "left").withColumn("code", F.coalesce("code", F.array().cast("array<array<string>>")))
    held: dict = {}
    names = ("n", "n_both", "n_scored", "n_equal", "n_tried", "n_ratios")

    def run(rows: pa.Table, left: tuple[int, int], right: tuple[int, int], ok: np.ndarray, product) -> dict | None:
        x, y = np.nonzero(ok & (product(right, "", (True, True)) > 0))
        if not len(x):
            return None
        if held.get("rows") is not rows:  # one cell at a time
            held.update(rows=rows, sides=Sides(rows["code"].combine_chunks()), doc=rows["doc"].to_numpy())
        x, y, doc, sides = x + left[0], y + right[0], held["doc"], held["sides"]
        a, b = np.where(doc[x] < doc[y], x, y), np.where(doc[x] < doc[y], y, x)
        n = len(a)
        some = np.diff(sides.doc) > 0
        both = some[a] & some[b]
        score, tried, ratios = sides.scores(a[both], b[both])
        return {c: np.array([v], np.int64) for c, v in zip(names, (n, both.sum(), (score > 0).sum(), (score >= 0.999).sum(), tried.sum(), ratios.sum()))}

    parts = products.in_tiles(rows, run, ", ".join(f"{c} long" for c in names))
    return parts.groupBy("batch").agg(*(F.sum(c).alias(c) for c in names))


def max_block_similarity(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(batch, a, b, code_score) of ``block_scores``."""
    return block_scores(pairs, blocks).select("batch", "a", "b", "code_score")


def with_code_score(pairs: DataFrame, code: DataFrame) -> DataFrame:
    """All pairs with their code score; 0 where a side has no code."""
    return pairs.join(code, ["batch", "a", "b"], "left").withColumn("code_score", F.coalesce("code_score", F.lit(0.0)))


def token_grams(blocks: DataFrame, k: int = 5) -> DataFrame:
    """(batch, doc, text): token k-grams of each document as words, for the candidate search of operators.similarity."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens") - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice("tokens", i, F.lit(k)), "_"))
    return blocks.groupBy("batch", "doc").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(grams)))), " ").alias("text"))
