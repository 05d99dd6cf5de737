"""The query language: text to syntax tree to one lazy DataFrame."""
