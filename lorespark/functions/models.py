"""Models that callers plug in, with local stand-ins that need no service."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence

import numpy as np

Embedder = Callable[[Sequence[str]], np.ndarray]
Chat = Callable[[str, str], str]

#: Fixed value: the answer when the chat model fails.
DEGRADED = "服务繁忙，请稍后再试"


def hashing_embedder(size: int = 64) -> Embedder:
    """Words hashed to signed places."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % size] += 1 if h >> 32 & 1 else -1
        return out

    return embed


def batched(embed: Embedder, size: int = 10, retries: int = 2, wait: float = 0.5, sleep=time.sleep) -> Embedder:
    """embed in requests of size texts; connection errors are tried again after wait, then twice wait."""

    def run(texts: Sequence[str]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), size):
            for attempt in range(retries + 1):
                try:
                    out.append(embed(texts[at : at + size]))
                    break
                except (ConnectionError, TimeoutError):
                    if attempt == retries:
                        raise
                    sleep(wait * (attempt + 1))
        return np.concatenate(out) if out else np.zeros((0, 0))

    return run


def extractive_chat(system: str, user: str) -> str:
    """Answers with the first line of each numbered passage and its mark."""
    return "\n".join(f"{body.strip().splitlines()[0]}[来源{n}]" for n, body in re.findall(r"\[来源(\d+)\][^\n]*\n(.+?)(?=\n\n|\Z)", user, re.S))


def safe(chat: Chat) -> Chat:
    """chat with the degraded answer in place of errors and blank answers."""

    def run(system: str, user: str) -> str:
        try:
            return chat(system, user).strip() or DEGRADED
        except Exception:  # whatever a service raises
            return DEGRADED

    return run
