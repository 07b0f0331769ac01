"""Sources of transcripts."""

from __future__ import annotations


def connectors(recover: bool = False):
    """All connectors by agent, in the order of the slugs; with ``recover``, messages without a session make one up."""
    from functools import partial

    from .. import schema
    from . import hermes, opencode
    from .base import Connector
    from .formats import CONNECTORS

    own = CONNECTORS | {"hermes": Connector("hermes", ("state.db",), load=hermes.scan, inventory=hermes.inventory), "opencode": Connector("opencode", ("*.db", "*.json"), load=partial(opencode.scan, recover=recover), inventory=partial(opencode.inventory, recover=recover))}
    return {a: own[a] for a in schema.AGENTS}
