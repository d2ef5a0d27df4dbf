"""Training-data operators. Nothing outside this subpackage imports it.

Conventions shared by the operators (each docstring adds its own):

* ``documents`` needs ``doc_id`` and ``text``; further columns are ignored and
  may have any name.  Every input row is one document, so a repeated row gives
  a repeated result row.
* a null text is an empty text; a null ``doc_id`` is larger than any other.
* an empty table gives an empty result of the same schema.
"""
