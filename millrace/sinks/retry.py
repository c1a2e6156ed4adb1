"""Repeat a write that may fail. The write must be safe to repeat."""

import logging
import time

log = logging.getLogger("millrace")


def with_retry(write, attempts=3, delay=5.0, sleep=time.sleep):
    """write() up to that many times; the last error is raised."""
    for attempt in range(1, attempts + 1):
        try:
            return write()
        except Exception as error:
            log.warning("write attempt %d/%d failed: %s", attempt, attempts, error)
            if attempt == attempts:
                raise
            sleep(delay)
