"""Registered queries over the driver tables and the SQL each is compared with."""
