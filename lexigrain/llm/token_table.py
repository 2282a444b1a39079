"""The bytes that the ids of a byte-level BPE file stand for."""

from __future__ import annotations

import json


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, and its byte.

    Printable bytes stand for themselves, the others, in order, for the letters from 256.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


_tables: dict[str, list[bytes]] = {}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a file, kept by this worker process."""
    if path not in _tables:
        letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        added = {t["id"]: t["content"].encode() for t in data.get("added_tokens") or []}
        vocab = {i: text for text, i in data["model"]["vocab"].items()}
        _tables[path] = [
            added[i] if i in added else bytes(map(letters.__getitem__, vocab.get(i, "")))
            for i in range(max([*vocab, *added]) + 1)]
    return _tables[path]
