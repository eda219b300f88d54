"""Relational operators on the position grid."""
