"""Operators that prepare texts and event sequences for training; nothing outside this subpackage imports it."""
