"""Tables: external frames and the managed, versioned warehouse."""
