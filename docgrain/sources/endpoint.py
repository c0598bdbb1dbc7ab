"""A translator that asks a model server over HTTP, one isolated request per row."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

from ..plans.transform import Failure
from ..plans.requests import STOP, TEMPLATES, USER_TEMPLATES, Config, field_values, fill_template

MOST_BYTES = 32 << 20


def _body(config: Config, values: dict[str, str]) -> tuple[str, dict]:
    body: dict = {"model": config.model, "temperature": 0, "stream": False}
    if config.transport == "completions":
        template = TEMPLATES.get(config.prompt_template.strip(), config.prompt_template)
        return "/completions", body | {"prompt": fill_template(template, values), "stop": list(config.stop or STOP)}
    messages = [{"role": "system", "content": values["System"]}, {"role": "user", "content": values["User"]}]
    if config.user_template:
        template = USER_TEMPLATES.get(config.user_template.strip(), config.user_template)
        messages = [{"role": "user", "content": fill_template(template, values)}]
    if config.reasoning.strip():
        body["reasoning_effort"] = config.reasoning.strip()
    return "/chat/completions", body | {"messages": messages}


def _reply(config: Config, path: str, body: dict) -> str | Failure:
    """One request: its text, or the kind of failure and what was said."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {config.token}"} if config.token else {})
    request = urllib.request.Request(config.url.rstrip("/") + path, json.dumps(body).encode(), head, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=config.timeout_s) as r:
            data = r.read(MOST_BYTES)
    except urllib.error.HTTPError as e:
        return Failure("http", f"status {e.code}: {e.read(500).decode('utf-8', 'replace')}")
    except OSError as e:
        return Failure("http", str(e))
    try:
        reply = json.loads(data)
    except ValueError as e:
        return Failure("json", str(e))
    if not isinstance(reply, dict):
        return Failure("json", "not an object")
    if reply.get("error"):
        error = reply["error"]
        return Failure("endpoint", str(error.get("message", error) if isinstance(error, dict) else error))
    if not reply.get("choices"):
        return Failure("no_choices", "the reply has no choices")
    choice = reply["choices"][0]
    text = (choice.get("message") or {}).get("content") or choice.get("text") or ""
    if choice.get("finish_reason") not in (None, "", "stop"):
        return Failure("truncated", f"it ended by {choice['finish_reason']}")
    return text if text.strip() else Failure("empty", "the reply has no text")


def http_translator(config: Config, source_lang: str = "en", target_lang: str = "", parallel: int = 4):
    """A translator for :mod:`docgrain.plans.transform`, with ``parallel`` requests of a task at a time.
    Failed requests aren't repeated; the kinds of failures are those of ``requests.reply_outcome``."""
    if not config.ready:
        raise ValueError("no model is configured")

    def one(request: tuple[str, str]) -> str | Failure:
        return _reply(config, *_body(config, field_values(*request, source_lang, target_lang)))

    def ask(requests: list[tuple[str, str]]) -> list[str | Failure]:
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            return list(pool.map(one, requests))

    return ask
