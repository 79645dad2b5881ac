"""Bit-exact codecs as plain functions and Arrow UDFs."""
