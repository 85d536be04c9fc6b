"""All queries; importing this registers them."""

from lectern.plans import documents, files, html, ingest, joins, layout, learning, lines, listing, pages, reading, scalars, segments, streams  # noqa: F401
