"""What the engine raises."""


class DbmsError(Exception):
    """Root of all errors."""


class AccessDenied(DbmsError): ...


class SanitizeError(DbmsError): ...


class ValidationError(DbmsError): ...


class TableError(DbmsError): ...


class TransactionError(DbmsError): ...


class QueryError(DbmsError): ...


class InvalidQuery(QueryError): ...


class UnknownColumn(QueryError): ...


class TableNotFound(QueryError): ...


class AggregateClauseInSelect(QueryError): ...


class JoinInsideTypedSelect(QueryError): ...


class PrimaryKeyConflict(QueryError): ...


class UniqueViolation(QueryError): ...


class BrokenForeignKeyReference(QueryError): ...


class ForeignKeyConstraintViolation(QueryError): ...


class MissingNonNullableField(QueryError): ...


class AutoincrementOverflow(QueryError): ...


class MigrationError(DbmsError): ...


class SchemaDrift(MigrationError): ...


class DestructiveOperation(MigrationError): ...


class MissingDefault(MigrationError): ...


class IncompatibleType(MigrationError): ...


class ConstraintViolation(MigrationError): ...


class TransformFailed(MigrationError): ...
