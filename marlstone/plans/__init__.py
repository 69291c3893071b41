"""The queries; importing this package registers them."""

from . import answers, entities, market, records  # noqa: F401
