"""Snapshots, and the card and signature of a report's push. Sending is injected."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Callable

from quillstream.sources.tables import Tables

# Characters of one text block, and bytes of a whole card.
MOST_CHARS, MOST_BYTES = 6000, 28000


def snapshot(t: Tables, folder: str, stamp: str) -> str:
    """All tables as Parquet in a new folder; one that exists is an error."""
    path = f"{folder.rstrip('/')}/{stamp}"
    for name, df in t.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return path


def signature(secret: str, timestamp: int) -> str:
    key = f"{timestamp}\n{secret}".encode()
    return base64.b64encode(hmac.new(key, b"", hashlib.sha256).digest()).decode()


def chunks(text: str, most: int = MOST_CHARS) -> list[str]:
    return [text[i : i + most] for i in range(0, len(text), most)] or [""]


def card(report: dict, most_bytes: int = MOST_BYTES) -> dict:
    """A card of a report: title and level, overview, then details in blocks; blocks at the end go until it fits."""
    colour = {"critical": "red", "high": "orange", "medium": "yellow"}.get(report.get("risk_level") or "low", "green")
    blocks = [report.get("overview") or ""]
    blocks += [f"**{d['title']}**\n{d['content']}" for d in report.get("details") or []]
    elements = [{"tag": "markdown", "content": part} for b in blocks for part in chunks(b)]
    out = {"header": {"template": colour, "title": {"tag": "plain_text", "content": (report.get("title") or "")[:200]}}, "elements": elements}
    while len(elements) > 1 and len(json.dumps(out, ensure_ascii=False).encode()) > most_bytes:
        elements.pop()
    return out


def push(report: dict, send: Callable[[bytes], dict], timestamp: int, secret: str | None = None) -> dict:
    """Sends the card, signed if there is a secret; an answer with a code other than 0 is an error."""
    body: dict = {"msg_type": "interactive", "card": card(report)}
    if secret:
        body |= {"timestamp": str(timestamp), "sign": signature(secret, timestamp)}
    answer = send(json.dumps(body, ensure_ascii=False).encode())
    if answer.get("code", 0) != 0:
        raise RuntimeError(str(answer.get("msg") or answer))
    return answer
