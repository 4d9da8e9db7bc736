"""Registered queries over the operators, with equivalent SQL."""
