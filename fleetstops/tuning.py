"""Tuning values: they change cost, never results."""

#: Length of the calendar pieces that every vehicle's history is cut into, in seconds: one day. A piece is one task's
#: unit of work, so a vehicle that sends very many readings wants a shorter one.
CHUNK_SECONDS = 86_400

#: Length of the calendar pieces that readings are numbered in, in seconds.
ID_PIECE_SECONDS = 60

#: Pieces that readings without a time are numbered in.
UNTIMED_PIECES = 4096
