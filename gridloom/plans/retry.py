"""Retries on the driver; Spark retries its tasks itself."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 1
    backoff_seconds: float = 0.0
    retryable: tuple[type[BaseException], ...] = (Exception,)

    def __post_init__(self):
        if self.max_attempts < 1 or self.backoff_seconds < 0:
            raise ValueError("a policy needs an attempt, and no negative waits")


def attempt(work: Callable[..., Any], *args: Any, policy: RetryPolicy = RetryPolicy(), **kwargs: Any) -> tuple[Any, BaseException | None, int]:
    """(result, last error, attempts); waits grow by one backoff each time.

    An error that isn't retryable ends it at once.
    """
    for n in range(1, policy.max_attempts + 1):
        try:
            return work(*args, **kwargs), None, n
        except Exception as error:
            if not isinstance(error, policy.retryable) or n == policy.max_attempts:
                return None, error, n
            time.sleep(policy.backoff_seconds * n)
    raise AssertionError
