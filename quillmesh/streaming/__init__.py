"""The same operators over streams: scoring rows as they arrive and windowed counts with late data."""
