"""The stateless labelling columns, applied to a streaming DataFrame."""
