"""Encoding whole texts through a cache of their parts."""

from __future__ import annotations

from collections.abc import Callable

#: Distinct blank-separated parts that a worker remembers with their ids, unless the encoder says otherwise.
PARTS = 250_000
#: Parts that are encoded together.
STEP = 100_000


class Pieces:
    """packed_all(texts) gives each text's ids as little-endian unsigned 32-bit integers.

    ``encode`` maps parts to their packed ids. A text is cut at its blanks, and each part is looked
    up with the blank before it: in the pattern of the installed vocabularies a blank that no white
    space precedes starts a pre-token, so a part's ids don't depend on what is around it. Texts in
    which white space precedes a blank are one part. ``inner`` maps parts that start with such a
    blank and end in no white space; it may encode them side by side. A full cache keeps what the
    batch at hand uses; the rest starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], inner: Callable[[list[str]], list[bytes]] | None = None, room: int = PARTS):
        self.encode, self.inner, self.room = encode, inner or encode, room
        self._known: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        return self.packed_all([text])[0]

    def packed_all(self, texts: list[str]) -> list[bytes]:
        known = self._known
        cut = [text.split(" ") for text in texts]
        used = set().union(*[parts[1:-1] for parts in cut])
        fresh = used.difference(known)
        bad = {x for x in fresh if not x or x[-1].isspace()}
        whole = {k for k, parts in enumerate(cut) if len(parts) < 2 or parts[0][-1:].isspace() or bad and not bad.isdisjoint(parts[1:-1])}
        if whole:
            used = set().union(*[parts[1:-1] for k, parts in enumerate(cut) if k not in whole])
            fresh = used.difference(known)
        if len(known) + len(fresh) > self.room:
            known = self._known = {x: known[x] for x in used if x in known}
        order = list(fresh)
        for k in range(0, len(order), STEP):
            step = order[k : k + STEP]
            known.update(zip(step, self.inner([" " + x for x in step]), strict=True))
        ends = list({y for k, parts in enumerate(cut) for y in ((texts[k],) if k in whole else (parts[0], " " + parts[-1]))})
        ids = dict(zip(ends, self.encode(ends), strict=True))
        return [ids[texts[k]] if k in whole else ids[parts[0]] + b"".join([known[x] for x in parts[1:-1]]) + ids[" " + parts[-1]] for k, parts in enumerate(cut)]
