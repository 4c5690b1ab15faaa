"""A completion back end over HTTP: an endpoint that takes chat messages as JSON."""

from __future__ import annotations

import json
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from ..operators.completion import RateLimited
from ..params import Completion


def marked(messages: list[dict], least: int) -> list[dict]:
    """Messages with the marks of what the service may cache: long system messages, and in a dialogue the first long turn of the user."""
    dialogue, first, out = sum(m["role"] == "user" for m in messages) > 1, True, []
    for m in messages:
        long = len(m["content"]) >= least
        if long and (m["role"] == "system" or m["role"] == "user" and dialogue and first):
            first = first and m["role"] != "user"
            out.append({"role": m["role"], "content": [{"type": "text", "text": m["content"], "cache_control": {"type": "ephemeral"}}]})
        else:
            out.append({"role": m["role"], "content": m["content"]})
    return out


class ChatEndpoint:
    """A backend for Service: posts a request and gives the reply's text and token counts. A status of 429 asks for a pause, and a reply without text is an error."""

    def __init__(self, url: str, key: str = "", params: Completion = Completion(), cache: bool = True):
        self.url, self.key, self.params, self.cache = url, key, params, cache

    def __call__(self, request: dict) -> tuple[str, dict]:
        messages = [{"role": m["role"], "content": m["content"]} for m in request["messages"]]
        body = {"model": self.params.model, "messages": marked(messages, self.params.cache_chars) if self.cache else messages, "temperature": float(request["temperature"]), "max_tokens": int(request["max_tokens"])}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with urlopen(Request(self.url, data=json.dumps(body).encode(), headers=headers), timeout=self.params.timeout) as r:  # noqa: S310
                reply = json.load(r)
        except HTTPError as e:
            raise RateLimited(str(e)) if e.code == 429 else e from None
        content = reply["choices"][0]["message"]["content"]
        if content is None:
            raise ValueError("a reply without text")
        used = reply.get("usage") or {}
        cached = used.get("cache_read_input_tokens") or (used.get("prompt_tokens_details") or {}).get("cached_tokens")
        return content, {"prompt_tokens": used.get("prompt_tokens") or 0, "completion_tokens": used.get("completion_tokens") or 0, "cached_tokens": cached or 0}
