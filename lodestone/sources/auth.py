"""Signing in to services (OAuth 2): a stored token is used while it is valid, refreshed when it is not, and asked for by consent when there is none.

How a token is refreshed or consented to is a function that the caller passes; those for the standard endpoints are here. Tokens live in a
file on the driver and never in a table or a plan.
"""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from urllib.parse import urlencode
from urllib.request import Request, urlopen

log = logging.getLogger("lodestone.auth")
#: Seconds before its end at which a token no longer counts as valid.
MARGIN = 60


@dataclass(frozen=True)
class Token:
    access: str
    refresh: str | None = None
    #: Seconds since 1970; none for a token that does not end.
    expires: float | None = None

    def valid(self, now: float) -> bool:
        return bool(self.access) and (self.expires is None or now < self.expires - MARGIN)


def load_token(path: str) -> Token | None:
    """The stored token; none if there is no file or it holds none."""
    try:
        with open(path, encoding="utf-8") as f:
            return Token(**json.load(f))
    except (OSError, ValueError, TypeError):
        return None


def save_token(path: str, token: Token) -> None:
    """Only the owner may read the file."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        json.dump(asdict(token), f)


def sign_in(path: str, refresh: Callable[[Token], Token], consent: Callable[[], Token] | None = None, now: Callable[[], float] = time.time) -> Token | None:
    """A valid token, stored at path; none, and a message, if signing in fails."""
    token = load_token(path)
    try:
        if token is None or not token.valid(now()):
            if token is not None and token.refresh:
                token = refresh(token)
            elif consent is not None:
                token = consent()
            else:
                log.error("no token at %s, and none can be asked for", path)
                return None
            save_token(path, token)
        return token
    except Exception as e:  # noqa: BLE001  whatever goes wrong, the analysis goes on without the service
        log.error("signing in failed: %s", e)
        return None


def _granted(credentials: dict, fields: dict, old: str | None = None) -> Token:
    """The token that the service's token endpoint gives."""
    body = urlencode({"client_id": credentials["client_id"], "client_secret": credentials["client_secret"], **fields}).encode()
    with urlopen(Request(credentials["token_uri"], data=body), timeout=30) as r:  # noqa: S310
        found = json.load(r)
    ends = time.time() + found["expires_in"] if "expires_in" in found else None
    return Token(found["access_token"], found.get("refresh_token", old), ends)


def load_credentials(path: str) -> dict:
    """client_id, client_secret, auth_uri and token_uri from a file, in which they may lie a level deeper."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return found if "client_id" in found else next(v for v in found.values() if isinstance(v, dict) and "client_id" in v)


def refresher(credentials: dict) -> Callable[[Token], Token]:
    return lambda token: _granted(credentials, {"grant_type": "refresh_token", "refresh_token": token.refresh}, token.refresh)


def console_consent(credentials: dict, scope: str, ask: Callable[[str], str] = input, redirect: str = "urn:ietf:wg:oauth:2.0:oob") -> Callable[[], Token]:
    """Shows where to consent and asks for the code."""

    def consent() -> Token:
        where = f"{credentials['auth_uri']}?{urlencode({'client_id': credentials['client_id'], 'redirect_uri': redirect, 'response_type': 'code', 'scope': scope, 'access_type': 'offline'})}"
        code = ask(f"open {where}\ncode: ").strip()
        return _granted(credentials, {"grant_type": "authorization_code", "code": code, "redirect_uri": redirect})

    return consent


def http_transport(endpoint: str, token: Token, field: str = "rows", timeout: float = 60.0) -> Callable[[dict], list[dict]]:
    """A transport for sources.api: posts the request to the endpoint, in whose address {names} stand for the request's values, and gives the rows of the reply."""

    def rows(request: dict) -> list[dict]:
        from urllib.parse import quote

        url = endpoint.format(**{k: quote(str(v), safe="") for k, v in request.items()})
        sent = Request(url, data=json.dumps(request).encode(), headers={"Authorization": f"Bearer {token.access}", "Content-Type": "application/json"})
        with urlopen(sent, timeout=timeout) as r:  # noqa: S310
            return json.load(r).get(field) or []

    return rows
