"""Registered queries over the sample tables and the plain SQL that checks them."""
