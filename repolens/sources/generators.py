"""Description generators over HTTP.

``HttpGenerator`` posts a prompt to an endpoint of the common messages shape and returns the first text block.  Several of
them go into ``plans.describe.Pool``, which retries what is worth retrying.  Instances travel to the executors, so they hold
settings only.
"""

from __future__ import annotations

import json
import logging
import urllib.error
import urllib.request
from dataclasses import dataclass

from repolens.plans.describe import Pool, TransientError

log = logging.getLogger("repolens")


@dataclass(frozen=True)
class HttpGenerator:
    """One model behind ``url``; without a key nothing is asked and nothing comes back."""

    url: str
    model: str
    key: str | None = None
    timeout: float = 60.0

    def __call__(self, prompt: str, max_tokens: int = 150) -> str | None:
        if not self.key:
            return None
        body = {"model": self.model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}]}
        headers = {"Content-Type": "application/json", "x-api-key": self.key, "Authorization": f"Bearer {self.key}"}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                blocks = json.load(answer).get("content") or []
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise TransientError(str(e)) from e
            log.warning("model %s refused a prompt: %s", self.model, e)
            return None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise TransientError(str(e)) from e
        text = next((b.get("text", "") for b in blocks if b.get("type", "text") == "text"), "").strip()
        return text or None


def http_pool(url: str, key: str | None, models: dict[str, int]) -> Pool:
    """A pool of models with so many slots each."""
    return Pool([(HttpGenerator(url, model, key), slots) for model, slots in models.items()])
