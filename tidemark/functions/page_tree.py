"""The element tree of pages, from the kinds and names of their tokens.

A batch holds the tokens of many pages, one page after the other. Start tags find their ends in
one pass over a page; depth, enclosing areas and counts are running sums over the whole batch.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def page_ends(codes: list[int], steps: list[tuple], inline: list[bool], border: list[bool]) -> list[int]:
    """Place of the token that ends each start tag of one page, -1 for other tokens.

    ``steps`` holds per code the families it takes part in: (family, level change, opens, closes).
    """
    ends = [-1] * len(codes)
    level: dict = {}
    waiting: dict = {}
    for i, code in enumerate(codes):
        for family, delta, opens, closes in steps[code]:
            at = level.get(family, 0)
            if delta:
                # Never below zero, so stray end tags do not shift later levels.
                level[family] = max(at + delta, 0)
                at = level[family] + (delta < 0)
            if closes:
                for start in waiting.pop((family, at), ()):
                    ends[start] = i
            if opens:
                waiting.setdefault((family, at), []).append(i)
    left = [start for starts in waiting.values() for start in starts]
    borders = [i for i, code in enumerate(codes) if border[code]] if left else []
    for start in left:
        after = bisect_right(borders, start) if inline[codes[start]] else len(borders)
        ends[start] = borders[after] if after < len(borders) else len(codes)
    return ends


def page_ancestors(depths: list[int], opens: list[bool], levels: int) -> list[list[int]]:
    """Per level the place of the last element that many depths above each token, -1 without one."""
    out: list[list[int]] = [[] for _ in range(levels)]
    latest: dict = {}
    for i, depth in enumerate(depths):
        for k, column in enumerate(out, 1):
            column.append(latest.get(depth - k, -1))
        if opens[i]:
            latest[depth] = i
    return out


def page_trees(marks: pa.ListArray, masks: pa.ListArray, refs: pa.ListArray, shape: dict) -> pa.ListArray:
    """One struct per token, in the fields that ``fields_of(shape)`` names; places count from 0 within a page.

    ``marks``: "kind name" of every token, for texts whether they are #blank, #empty or #said; ``masks``: bits of the flags that need more than a name,
    ``refs``: the id that a label or a field refers to (both empty when not asked for).
    """
    sizes = pc.list_value_length(marks).to_numpy(zero_copy_only=False).astype(np.int64)
    total = int(sizes.sum())
    firsts = np.cumsum(sizes) - sizes
    coded = marks.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    names = [tuple(mark.split(" ", 1)) for mark in coded.dictionary.to_pylist()]
    by_name = lambda test: np.array([test(*name) for name in names], dtype=bool)[code]
    first, size = np.repeat(firsts, sizes), np.repeat(sizes, sizes)
    number = np.arange(total)
    place = number - first
    # A page has one slot more than tokens, for what ends with it.
    slot = number + np.repeat(np.arange(len(sizes)), sizes)
    base, slots = slot - place, total + len(sizes)

    opens, closing = by_name(lambda kind, _: kind == "open"), by_name(lambda kind, _: kind == "close")
    element, text = by_name(lambda kind, _: kind in ("open", "void")), by_name(lambda kind, _: kind == "text")
    plain = {"open": lambda tag: ((tag, 1, True, False),), "close": lambda tag: ((tag, -1, False, True),)}
    steps = [shape["known"].get(name) or (plain[name[0]](name[1]) if name[0] in plain else ()) for name in names]
    inline = [tag in shape["inline"] for _, tag in names]
    border = [kind in plain and tag in shape["blocks"] for kind, tag in names]
    codes, pages = code.tolist(), [(int(a), int(a + n)) for a, n in zip(firsts, sizes)]
    end = np.array([e for a, b in pages for e in page_ends(codes[a:b], steps, inline, border)], dtype=np.int64)
    end = np.where(element & ~opens, place, end)
    tags: dict = {}
    tag_no = np.array([tags.setdefault(tag, len(tags)) for _, tag in names], dtype=np.int64)[code]
    shut = opens & (end < size)
    closer = np.where(shut, first + end, 0)
    cover = end + (shut & closing[closer] & (tag_no[closer] == tag_no))

    def before(flag: np.ndarray) -> np.ndarray:
        """Flagged tokens of the batch before each slot."""
        steps = np.zeros(slots + 1, dtype=np.int64)
        steps[slot[flag] + 1] = 1
        return np.cumsum(steps)

    def around(flag: np.ndarray) -> np.ndarray:
        """Flagged elements that hold each token."""
        steps = np.zeros(slots + 1, dtype=np.int64)
        steps[slot[flag] + 1] = 1
        np.subtract.at(steps, (base + cover)[flag], 1)
        return np.cumsum(steps)[slot]

    texts = before(text)
    depth = around(opens) + 1
    out = {"end": end, "depth": depth, "tb": texts[slot] - texts[base], "te": np.where(element, texts[base + np.maximum(end, 0)] - texts[base], -1)}
    depths, open_list = depth.tolist(), opens.tolist()
    ups: list[list[int]] = [[] for _ in range(shape["levels"])]
    for a, b in pages:
        for column, part in zip(ups, page_ancestors(depths[a:b], open_list[a:b], len(ups))):
            column += part
    for k, column in enumerate(ups, 1):
        out[f"up_{k}"] = np.array(column, dtype=np.int64)
    child = element & (out["up_1"] >= 0)
    out["children"] = np.bincount((first + out["up_1"])[child], minlength=total)[:total]
    pair = lambda a, b: (a >= 0) & (b < total)
    near = lambda k: np.clip(number + k, 0, max(total - 1, 0))
    same = lambda a, b: opens[near(a)] & closing[near(b)] & (tag_no[near(a)] == tag_no[near(b)])
    inner = text & pair(place - 1, number + 1) & (place + 1 < size) & same(-1, 1)
    last = closing & (place >= 2) & text[near(-1)] & same(-2, 0)
    out["leaf"] = (inner | last).astype(np.int64)

    bits = masks.flatten().to_numpy(zero_copy_only=False)
    flags = {}
    for name, (wanted, bit) in shape["flags"].items():
        hit = by_name(lambda _, tag: tag in wanted) if wanted is not None else (bits >> bit) & 1 == 1
        flags[name] = hit & element
    for name in shape["areas"]:
        out[f"in_{name}"] = around(flags[f"in {name}"] & opens)
    for name in shape["counted"]:
        counts = before(element & by_name(lambda _, tag: tag == name))
        out[f"seen_{name}"] = counts[slot] - counts[base]
        out[f"ended_{name}"] = np.where(element, counts[base + np.maximum(end, 0)] - counts[base], -1)

    def latest_of(flag: np.ndarray) -> np.ndarray:
        """The latest flagged element before each token, if it is still open there."""
        known = np.concatenate(([-1], np.maximum.accumulate(np.where(flag, number, -1))))[:total]
        open_still = (known >= first) & (end[np.maximum(known, 0)] > place) if total else known >= first
        return np.where(open_still, known - first, -1)

    for name in shape["latest"]:
        out[f"last_{name}"] = latest_of(flags[f"last {name}"])
    for name in shape["following"]:
        ahead = np.minimum.accumulate(np.where(flags[f"next {name}"], number, total)[::-1])[::-1]
        ahead = np.concatenate((ahead, [total]))[1 : total + 1]
        out[f"next_{name}"] = np.where(ahead < first + size, ahead - first, -1)
    if shape["roots"]:
        inside, otherwise, without = shape["roots"]
        tag_is = lambda *wanted: by_name(lambda kind, tag: kind != "text" and tag in wanted)
        over, top = np.where(out["up_1"] >= 0, first + out["up_1"], 0), out["up_1"] < 0
        found = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[element & tag_is(inside)], minlength=len(sizes))[: len(sizes)]
        root = np.where(np.repeat(found > 0, sizes), ~top & tag_is(inside)[over], top | tag_is(otherwise)[over])
        out["is_root"] = (root & element & ~tag_is(*without)).astype(np.int64)
        out["last_root"] = latest_of(out["is_root"] == 1)
    if shape["refs"]:
        said = before(by_name(lambda kind, tag: kind == "text" and tag == "#said"))
        has_text = element & (said[base + np.maximum(end, 0)] > said[slot])
        named = lambda *wanted: element & by_name(lambda _, tag: tag in wanted)
        spoken = (text & by_name(lambda _, tag: tag != "#blank")) | (named("label", "span", "p") & has_text)
        out["sib"], out["sib_wide"], out["sib_said"] = _siblings(
            first, out["up_1"], named("label", "span", "p", "dt"), named("label", "span", "p", "dt", "th"), spoken, named("input", "textarea", "select")
        )
        order = np.flatnonzero(element)
        order = order[np.lexsort((order, out["up_1"][order], first[order]))]
        then, out["next_sib"] = order[1:], np.full(total, -1)
        kin = (first[then] == first[order[:-1]]) & (out["up_1"][then] == out["up_1"][order[:-1]])
        out["next_sib"][order[:-1][kin]] = place[then[kin]]
        out["ref_before"], out["ref_first"] = _referred(refs, flags["last label"], out["last_form"], first)
    return _listed(out, sizes, shape)


def _siblings(
    first: np.ndarray, parent: np.ndarray, near: np.ndarray, wide: np.ndarray, spoken: np.ndarray, asking: np.ndarray
) -> list[np.ndarray]:
    """For the asking tokens the last sibling before of two kinds, and the first sibling that says something."""
    out = [np.full(len(first), -1) for _ in range(3)]
    at = np.flatnonzero(wide | spoken | asking)
    last_near: dict = {}
    last_wide: dict = {}
    first_said: dict = {}
    families = list(zip(first[at].tolist(), parent[at].tolist()))
    rows = list(zip(at.tolist(), families, near[at].tolist(), wide[at].tolist(), spoken[at].tolist(), asking[at].tolist()))
    for i, family, is_near, is_wide, is_spoken, asks in rows:
        if asks:
            out[0][i], out[1][i] = last_near.get(family, -1), last_wide.get(family, -1)
        if is_near:
            last_near[family] = i - family[0]
        if is_wide:
            last_wide[family] = i - family[0]
        if is_spoken:
            first_said.setdefault(family, i - family[0])
    for i, family, *_, asks in rows:
        if asks:
            out[2][i] = first_said.get(family, -1)
    return out


def _referred(refs: pa.ListArray, label: np.ndarray, form: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the last label before with the same reference, and of the first one in the same form."""
    coded = refs.flatten().dictionary_encode().indices
    at = np.flatnonzero(coded.is_valid().to_numpy(zero_copy_only=False))
    values = coded.drop_null().to_numpy(zero_copy_only=False)
    before, scoped = np.full(len(label), -1), np.full(len(label), -1)
    last: dict = {}
    anywhere: dict = {}
    in_form: dict = {}
    for i, value in zip(at.tolist(), values.tolist()):
        name = (int(first[i]), value)
        before[i] = last.get(name, -1)
        if label[i]:
            place = i - name[0]
            last[name] = place
            anywhere.setdefault(name, place)
            in_form.setdefault((name, int(form[i])), place)
    for i, value in zip(at.tolist(), values.tolist()):
        name = (int(first[i]), value)
        scoped[i] = in_form.get((name, int(form[i])), -1) if form[i] >= 0 else anywhere.get(name, -1)
    return before, scoped


def fields_of(shape: dict) -> list[str]:
    """Names of the fields of a token's struct."""
    names = ["end", "depth", "tb", "te", *[f"up_{k}" for k in range(1, shape["levels"] + 1)], "children", "leaf"]
    names += [f"in_{name}" for name in shape["areas"]]
    names += [f"{side}_{name}" for name in shape["counted"] for side in ("seen", "ended")]
    names += [f"last_{name}" for name in shape["latest"]] + [f"next_{name}" for name in shape["following"]]
    names += ["is_root", "last_root"] if shape["roots"] else []
    return names + (["ref_before", "ref_first", "sib", "sib_wide", "sib_said", "next_sib"] if shape["refs"] else [])


def _listed(columns: dict, sizes: np.ndarray, shape: dict) -> pa.ListArray:
    names = fields_of(shape)
    arrays = [pa.array(columns[n].astype(np.int32), mask=columns[n] < 0) for n in names]
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, names))
