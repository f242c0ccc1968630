"""The cube is additive, so it can be kept up to date from a stream. An extension; batch operators read its output."""
