"""Coarse-to-fine search: a tree of bounds over blocks of vectors, searched by many users at once.

Each block is a box that holds its vectors.  The boxes are the leaves of a binary tree, split where
their centres spread most; a node's box holds those of its children, so its upper bound for a user's dot
product is that of all below it.  A search first follows the most promising nodes down to some leaves, whose
lower bounds prove a limit for the user's k-th best.  Then it opens the tree level by level from
the root and goes on below the nodes that reach the limit.  The leaves that are left hold all of the user's best.

A tree is a dict of arrays, so that tasks need no class of this module; its size follows the
number of blocks, which the caller bounds.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# Functions for tasks travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Nodes that are followed down to prove the limit.
PROBED = 16
#: Rounding may move a bound by about 1e-15; the margin keeps the pruning safe.
MARGIN = 1e-9
#: Mark of every node that holds a block; users ask for it.
HELD = 1 << 30
#: Blocks from which a split follows the main direction of the centres, not an axis.
_DIRECTION_FROM = 24
_USERS = 256


def _split(centres: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = centres[members]
    if len(members) >= _DIRECTION_FROM:
        moved = own - own.mean(axis=0)
        place = moved @ np.linalg.eigh(moved.T @ moved)[1][:, -1]
    else:
        place = own[:, np.argmax(own.var(axis=0))]
    members = members[np.argsort(place, kind="stable")]
    half = (len(members) + 1) // 2
    return members[:half], members[half:]


def build_tree(low: np.ndarray, high: np.ndarray, count: np.ndarray, marks: np.ndarray) -> dict:
    """A tree over boxes ``low`` to ``high`` (rows), each with ``count`` items and bits ``marks``.

    Arrays by level, the root first: ``low``, ``high``, ``marks`` (all bits below); and of the
    leaves ``count`` and ``block``, the row of the box or -1.
    """
    groups = [np.arange(len(count))]
    while max(map(len, groups), default=0) > 1:
        groups = [half for g in groups for half in (_split((low + high) / 2, g) if len(g) > 1 else (g, g[:0]))]
    block = np.array([g[0] if len(g) else -1 for g in groups], np.int64)
    held = block >= 0
    lows = [np.where(held[:, None], low[block], np.inf)]
    highs = [np.where(held[:, None], high[block], -np.inf)]
    bits = [np.where(held, marks[block] | HELD, 0)]
    while len(bits[-1]) > 1:
        lows.append(lows[-1].reshape(-1, 2, low.shape[1]).min(axis=1))
        highs.append(highs[-1].reshape(-1, 2, low.shape[1]).max(axis=1))
        bits.append(np.bitwise_or.reduce(bits[-1].reshape(-1, 2), axis=1))
    for side in (*lows, *highs):
        side[~np.isfinite(side)] = 0.0  # of empty nodes, which no user may enter
    return {"low": lows[::-1], "high": highs[::-1], "marks": bits[::-1], "count": np.where(held, count[block], 0), "block": block}


def _upper(tree: dict, level: int, users: np.ndarray, asked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Upper bounds, -inf where a node lacks a mark that the user asks for."""
    high, low, marks = (tree[x][level][nodes] for x in ("high", "low", "marks"))
    bound = np.where(users >= 0, users * high, users * low).sum(axis=-1)
    return np.where((marks & asked) == asked, bound, -np.inf)


def _proven(tree: dict, users: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """A lower limit of each user's k-th best from the leaves of the most promising paths; bounds looked at."""
    nodes, looked = np.zeros((len(users), 1), np.int64), 0
    for level in range(1, len(tree["marks"])):
        nodes = np.concatenate([2 * nodes, 2 * nodes + 1], axis=1)
        looked += nodes.size
        if nodes.shape[1] > PROBED:
            bound = _upper(tree, level, users[:, None], asked[:, None], nodes)
            nodes = np.take_along_axis(nodes, np.argpartition(-bound, PROBED - 1, axis=1)[:, :PROBED], axis=1)
    high, low, marks = (tree[x][-1][nodes] for x in ("high", "low", "marks"))
    bound = np.where(users[:, None] >= 0, users[:, None] * low, users[:, None] * high).sum(axis=-1)
    count = np.where((marks & asked[:, None]) == asked[:, None], tree["count"][nodes], 0)
    order = np.argsort(-bound, axis=1)
    bound, count = np.take_along_axis(bound, order, axis=1), np.take_along_axis(count, order, axis=1)
    reached = np.cumsum(count, axis=1) >= k
    limit = np.take_along_axis(bound, reached.argmax(axis=1)[:, None], axis=1)[:, 0]
    return np.where(reached.any(axis=1), limit, -np.inf), looked


def search_tree(tree: dict, users: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(user, block, limit of each user, bounds looked at): the blocks that may hold one of a user's best ``k``.

    ``users``: one vector per row; ``asked``: the marks that a block must have for the user.
    """
    asked = asked | HELD
    found_users, found_blocks, limits, looked = [], [], [np.zeros(0)], 0
    for start in range(0, len(users), _USERS):
        part, marks = users[start : start + _USERS], asked[start : start + _USERS]
        limit, seen = _proven(tree, part, marks, k)
        who, nodes = np.arange(len(part)), np.zeros(len(part), np.int64)
        for level in range(len(tree["marks"])):
            if level:
                who, nodes = np.repeat(who, 2), np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
            bound = _upper(tree, level, part[who], marks[who], nodes)
            keep = (bound > -np.inf) & (bound >= limit[who] - MARGIN)
            seen += len(who)
            who, nodes = who[keep], nodes[keep]
        found_users.append(who + start)
        found_blocks.append(tree["block"][nodes])
        limits.append(limit)
        looked += seen
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + found_users), np.concatenate(none + found_blocks), np.concatenate(limits), looked
